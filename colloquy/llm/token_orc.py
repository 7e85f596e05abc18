"""Token ids of a corpus as ORC files in document order, and reading them back by stripe.

Documents are range-partitioned by id and sorted, so file k holds smaller ids than file k+1 and each file
ascends. A row is ``doc_id, part, local_start, n_tokens, ids``: ORC stores the ids with integer run-length
encoding (version 2), keeps a row index every ``row_index_stride`` rows and a Bloom filter on ``doc_id``, and
splits a file's stripes over tasks when reading; a filter on ``doc_id`` reaches the reader, which passes over
files, stripes and row groups by their statistics and Bloom filters. A document's place among the ids of
the whole corpus is its place in its part plus the sum over earlier parts, taken from the small columns
of the files (one row per part).

A tokenizer's vocabulary file is loaded once per Python worker. Distinct words are encoded once per worker
(up to a bound on what it remembers) and laid out by numpy. Edge cases: null text is empty and gives the end id alone; repeated doc_ids are
repeated rows (in text order); an empty table gives an empty folder with the schema. Only ``doc_id`` and
``text`` are read, so further columns may have any names.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import textkernel as tk
from colloquy.llm.shared import texts
from colloquy.llm.token_blocks import distinct_words

SCHEMA = "part int, local_start long, doc_id long, n_tokens long, ids array<int>"
_KEEP_WORDS = 1_000_000
_BLOCK = 8 << 20


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of words, remembered from block to block up to a bound: word k has ``length[k]`` ids from ``start[k]`` in ``flat``."""

    def __init__(self, path: str, end_id: int) -> None:
        self.tokenizer = _tokenizer(path)
        self.end_id = end_id
        self.folds_case = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # strings that the library takes as one token wherever they stand: texts with one are encoded whole
        added = {t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile(b"|".join(map(re.escape, sorted(added))), re.I) if added else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}  # the empty word stands for the end of a text
        self.flat, self.length = np.array([self.end_id], np.int32), np.array([1], np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _KEEP_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        text = [w.decode() for w in new]
        # Words of letters alone are one pre-token each, which ends with its one end-of-word token: they are encoded joined.
        plain = np.fromiter((t.isalpha() and max(t) < "\u0250" and "\u0130" not in t for t in text), bool, len(text))
        length = np.zeros(len(new), np.int64)
        parts: list[np.ndarray] = []
        order = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        for i in range(0, len(order[0]), 512):
            some = order[0][i : i + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([text[k] for k in some])], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids])
            length[some] = np.diff(ends, prepend=-1)
            parts.append(ids)
        for i in range(0, len(order[1]), 8192):
            some = order[1][i : i + 8192]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([text[k] for k in some], add_special_tokens=False)]
            length[some] = np.fromiter(map(len, got), np.int64, len(got))
            parts.append(np.fromiter(itertools.chain.from_iterable(got), np.int32))
        order = np.concatenate(order)
        new = [new[k] for k in order]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat, self.length = np.concatenate([self.flat, *parts]), np.concatenate([self.length, length[order]])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def encode_block(encoder: WordEncoder, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, each with the end id, and where each text begins."""
    codes, words, first = distinct_words(tk.LOWER[data] if encoder.folds_case else data, offs, tk.SPACE)
    number = encoder.numbers(words)
    n = len(offs) - 1
    keys = np.insert(number[codes] if len(codes) else codes, first[1:], 0)
    begin = np.cumsum(encoder.length) - encoder.length
    length = encoder.length[keys]
    where = np.concatenate([[0], np.cumsum(length)])
    ids = encoder.flat[tk.expand(begin[keys], length)]
    where = where[np.append(first[:-1] + np.arange(n), len(keys))]
    raw = data.tobytes()
    if encoder.added is None or not encoder.added.search(raw):
        return ids, where
    parts = [ids[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
    for k in range(n):
        text = raw[offs[k] : offs[k + 1]]
        if encoder.added.search(text):
            parts[k] = np.array([*encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids, encoder.end_id], np.int32)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, parts: int | None = None, row_index_stride: int = 1000, stripe_bytes: int = 16 << 20) -> None:
    """Encodes every text and writes the files under ``path``.

    ``parts``: number of files; by default the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, done = WordEncoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offs in tk.blocks(batch.column("text"), _BLOCK):
                ids, where = encode_block(encoder, data, offs)
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)), pa.array(done + where[:-1]), batch.column("doc_id").slice(a, n),
                        pa.array(np.diff(where)), pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["part", "local_start", "doc_id", "n_tokens", "ids"],
                )
                done += int(where[-1])

    ordered = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.stripe.size", stripe_bytes)
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before. Filter ``doc_id`` to prune."""
    rows = spark.read.schema(T._parse_datatype_string(SCHEMA)).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(starts), F.col("part") == F.col("p")).select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_checksum(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows with ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offs, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4")).cast("B")
            sums = [zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
