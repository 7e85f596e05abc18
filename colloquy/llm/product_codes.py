"""Compression of vectors into codes: each part of a vector becomes the index of its nearest codebook entry.

Method. Components become integers, so that sums and distances are exact and results do not depend on the order of rows. Each
round builds one kd-tree per codebook on the driver (a codebook has ``entries`` entries, whatever the table) and sends
it with the tasks. A batch of vectors walks a tree together: at every node the vectors part by the splitting plane, go down their own side
first, and then those whose bound does not exceed their best distance, an equal bound included, cross over; at equal distance the lower
index wins. Tasks add up components and counts per entry, Spark sums those, and the driver divides: at most
parts x entries rows.

Edge cases: rows with a null vector, or with null or non-finite components, are dropped; so are vectors whose length is not
that of the smallest kept id, or empty, or no multiple of ``parts``. Components beyond +-4096 count as +-4096, which keeps squared distances
in 64 bits. Ids may repeat: initial entries are the first by id (null ids last), then by vector. With fewer rows than entries
the codebooks are smaller; entries that nothing is nearest to stay. An empty table gives no rows. Columns other than the named are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import join_counted, materialise

_LIMIT = 1 << 24
_BATCH = 4096


@dataclass(frozen=True)
class ProductCodes:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    leaf: int = 2


class KdTree:
    """Exact nearest entries, for many vectors at once; integers only."""

    def __init__(self, entries: np.ndarray, leaf: int) -> None:
        self.entries = entries
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(entries)), leaf)

    def _grow(self, held: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        points = self.entries[held]
        wide = np.ptp(points, axis=0) if points.size else np.zeros(0, np.int64)
        if len(held) <= leaf or not wide.any():
            self.nodes[at] = (-1, np.sort(held))
            return at
        axis = int(wide.argmax())
        held = held[np.argsort(points[:, axis], kind="stable")]
        mid = len(held) // 2
        # Entries up to the plane stand on the low side, from it on the high side.
        self.nodes[at] = (axis, int(self.entries[held[mid], axis]), self._grow(held[:mid], leaf), self._grow(held[mid:], leaf))
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each vector, the lowest index among equals."""
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        index = np.full(len(vectors), len(self.entries))
        self._visit(0, vectors, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), best, index)
        return index, best

    def _visit(self, at: int, vectors: np.ndarray, rows: np.ndarray, bound: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """``bound``: of each row, the least squared distance that any entry of this node can have."""
        can = bound <= best[rows]
        rows, bound = rows[can], bound[can]
        if not len(rows):
            return
        axis, *node = self.nodes[at]
        if axis < 0:
            own = vectors[rows]
            for i in node[0].tolist():
                far = ((own - self.entries[i]) ** 2).sum(axis=1)
                wins = (far < best[rows]) | ((far == best[rows]) & (i < index[rows]))
                best[rows[wins]], index[rows[wins]] = far[wins], i
            return
        plane, low, high = node
        off = vectors[rows, axis] - plane
        first_low = off < 0
        beyond = np.maximum(bound, off * off)
        for side, near, far in ((first_low, low, high), (~first_low, high, low)):
            self._visit(near, vectors, rows[side], bound[side], best, index)
            self._visit(far, vectors, rows[side], beyond[side], best, index)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def integer_vectors(table: DataFrame, vector: str, how: ProductCodes) -> DataFrame:
    """``table`` with ``ints`` for ``vector``: rows with nulls, other than finite numbers, or odd lengths are dropped."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * how.scale), F.lit(_LIMIT)), F.lit(-_LIMIT)).cast("int"))
    return table.where(F.col(vector).isNotNull()).where(finite & (F.size(vector) > 0) & (F.size(vector) % how.parts == 0)).withColumn("ints", ints).drop(vector)


def _assign(vectors: np.ndarray, trees: list[KdTree]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and the summed squared distances of the rows."""
    width = vectors.shape[1] // len(trees)
    codes, error = np.zeros((len(vectors), len(trees)), np.int64), np.zeros(len(vectors), np.int64)
    for p, tree in enumerate(trees):
        codes[:, p], far = tree.nearest(vectors[:, p * width : (p + 1) * width])
        error += far
    return codes, error


def fit_codebooks(kept: DataFrame, how: ProductCodes) -> np.ndarray:
    """Codebooks (parts x entries x width) after all rounds, from ``id, ints`` of equal length."""
    start = [r["ints"] for r in kept.orderBy(F.asc_nulls_last("id"), "ints").limit(how.entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), how.parts, -1).transpose(1, 0, 2).copy()
    vectors, width = kept.select("ints"), books.shape[1] and books.shape[2]
    for _ in range(how.rounds):
        sent = kept.sparkSession.sparkContext.broadcast([KdTree(book, how.leaf) for book in books])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((how.parts, len(sent.value[0].entries), width), np.int64)
            count = np.zeros(total.shape[:2], np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, _BATCH):
                    found = _matrix(batch.column(0).slice(a, _BATCH), how.parts * width)
                    codes, _ = _assign(found, sent.value)
                    for p in range(how.parts):
                        np.add.at(total[p], codes[:, p], found[:, p * width : (p + 1) * width])
                        count[p] += np.bincount(codes[:, p], minlength=count.shape[1])
            p, e = np.nonzero(count)
            at = np.tile(np.arange(width), len(p))
            held = [np.repeat(p, width), np.repeat(e, width), at, total[p, e].ravel(), np.repeat(count[p, e], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in held], names=["part", "entry", "at", "total", "n"])

        added = vectors.mapInArrow(sums, "part long, entry long, at long, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in added.collect():
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        sent.destroy()
    return books


def encode(kept: DataFrame, books: np.ndarray, how: ProductCodes) -> DataFrame:
    """``id, label, code, error`` of each row of ``id, label, ints``; a code has two hex digits for each part."""
    trees = [KdTree(book, how.leaf) for book in books]
    digits = [f"{i:02x}" for i in range(how.entries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _BATCH):
                some = batch.slice(a, _BATCH)
                codes, error = _assign(_matrix(some.column("ints"), books.shape[0] * books.shape[2]), trees)
                text = ["".join(digits[i] for i in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), pa.array(text, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"id long, label {label}, code string, error long")


def codebook_digest(books: np.ndarray) -> str:
    """Lowercase hex sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", how: ProductCodes = ProductCodes()) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of all kept rows, written to the shared folder, and the codebooks."""
    given = table.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kept = materialise(integer_vectors(given, "vector", how), "vectors")
    first = kept.orderBy(F.asc_nulls_last("id"), "ints").select(F.size("ints")).first()
    kept = kept.where(F.size("ints") == (first[0] if first else 0))
    books = fit_codebooks(kept, how) if first else np.zeros((how.parts, 0, 0), np.int64)
    return materialise(encode(kept, books, how), "codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels, nulls together; a hot label stays where it is."""
    keyed = codes.withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = materialise(keyed.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    return join_counted(keyed, sums, ["of"], "n").drop("of", "n")
