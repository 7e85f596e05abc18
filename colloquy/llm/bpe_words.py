"""Byte-level BPE over a corpus by its distinct words.

1. Each batch of texts is cut into pre-tokens and numbered: a batch becomes one row with its distinct pre-tokens and,
   for each text, the positions as numbers of those. Batches are written to the shared folder in buckets by batch, so
   that a lost executor repeats no numbering and the positions, the bulk of the data, are never shuffled.
2. The distinct pre-tokens are exploded to rows of a word and its place (batch and number) and brought together by one shuffle on the word.
   A word is encoded once, with the rank file's merges, and its ids go back to the rows that it stands for.
3. The ids go to their batch, as lists of numbers, counts and ids, and are laid out there by position. Decoding joins a batch's distinct words with the
   token-byte table by id (a take from the table, which is sent to all tasks: its size is the vocabulary's).

A hot word is one row per batch at most. Where there are more than ``_WORD_ROWS`` batches its rows are dealt over groups of
about that size, each of which encodes it. Batches bound the other groups: a batch holds at most ``batch_rows`` texts and about
``batch_bytes``; one text is never split.

Edge cases: null or empty text has no ids (hash of nothing). Repeated rows are encoded each. Only ``doc_id`` and
``text`` are read, so further columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import textkernel as tk
from colloquy.llm.shared import bucketed, texts
from colloquy.llm.token_blocks import Ragged, distinct, pieces


def token_table(spark: SparkSession, rank_path: str) -> DataFrame:
    """``id, token`` of a rank file (lines of base64 and rank)."""
    lines = spark.read.text(rank_path if "://" in rank_path else f"file://{rank_path}")
    part = F.split("value", " ")
    return lines.where(F.length("value") > 0).select(part[1].cast("int").alias("id"), F.unbase64(part[0]).alias("token"))


_WORD_ROWS, _LIST_ROWS = 100_000, 500_000
_CODE_BITS, _TASK_BITS = 28, 14  # of a word's number in its batch, and of a batch's in its task


@lru_cache(2)
def _encoding(rank_path: str):
    """The tokenizer of a rank file, with a pattern that takes a whole pre-token as one piece."""
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, as many as the greatest needs (the first byte says how many)."""
    planes = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([planes]) + zstandard.compress(b"".join((numbers >> 8 * k & 0xFF).astype(np.uint8).tobytes() for k in range(planes)), 9)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    return sum((p.astype(np.int64) << 8 * k for k, p in enumerate(planes)), np.zeros(planes.shape[1], np.int64))


def _number(data: np.ndarray, offs: np.ndarray, pattern: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a block, the commonest first, the pre-tokens of all texts as numbers, and their counts."""
    where, first = pieces(data, offs)
    codes, chunks = distinct(data, where[:-1], where[1:])
    del where
    find, number, lists = _pattern(pattern).findall, {}, []
    for chunk in chunks:
        lists.append([number.setdefault(t, len(number)) for t in find(chunk.decode())])
    flat, at = Ragged(lists).lay_out(codes)
    del codes, lists, chunks
    rank = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
    place = np.empty(len(rank), np.int32)
    place[rank] = np.arange(len(rank))
    names = list(number)
    return [names[i].encode() for i in rank], place[flat], np.diff(at[first])


def number_batches(docs: DataFrame, pattern: str, batch_rows: int, batch_bytes: int) -> DataFrame:
    """``batch, doc_ids, counts, codes, words``: one row per batch of texts; word ``k`` has number ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows: list[pa.RecordBatch] = []
        size = 0
        first = TaskContext.get().partitionId() << _TASK_BITS
        number = itertools.count(first)

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows).combine_chunks()
            rows.clear()  # the batches as they came are as large again
            text = whole.column("text").chunk(0)
            data, offs = next((d, o) for _, _, d, o in tk.blocks(text, 1 << 62))
            words, codes, counts = _number(data, offs, pattern)
            batch = next(number)
            if batch - first >> _TASK_BITS or len(words) >> _CODE_BITS:
                raise ValueError("a task has too many batches, or a batch too many distinct words: give smaller partitions or batches")
            cols = [[batch], [whole.column("doc_id").to_pylist()], [counts.tolist()], [_pack(codes)], [words]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["batch", "doc_ids", "counts", "codes", "words"])

        for batch in batches:
            for a, b, data, _ in tk.blocks(batch.column("text")):
                if rows and (size + len(data) > batch_bytes or sum(r.num_rows for r in rows) + b - a > batch_rows):
                    yield flush()
                    size = 0
                rows.append(batch.slice(a, b - a))
                size += len(data)
        if rows:
            yield flush()

    return texts(docs).mapInArrow(run, "batch long, doc_ids array<long>, counts array<long>, codes binary, words array<binary>")


def _group_of(batch: Column, batches: int) -> Column:
    """Which group of a word's rows a batch falls into: hashed, for batch numbers are multiples with small remainders."""
    return F.pmod(F.xxhash64(batch), F.lit(-(-batches // _WORD_ROWS) or 1))


def encode_words(words: DataFrame, rank_path: str, batches: int) -> DataFrame:
    """``batch, steps, counts, ids`` of rows ``word, place``: lists of some of a batch's words (``steps`` between their numbers).

    A place is the batch and, in its low ``_CODE_BITS`` bits, the word's number there. ``batches``: how many there are.
    """

    keyed = words.withColumn("group", _group_of(F.shiftright("place", _CODE_BITS), batches))
    # dealt before they are gathered: the places of a word in one batch are one, so there is nothing to combine first
    met = keyed.repartition("word", "group").groupBy("word", "group").agg(F.collect_list("place").alias("places"))

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(rank_path).encode_ordinary_batch
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in arriving:
            ids = encode([w.decode() for w in batch.column("word").to_pylist()], num_threads=1)
            counts = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32)
            places = batch.column("places")
            row = np.repeat(np.arange(len(ids)), pc.list_value_length(places).to_numpy())
            begin = np.cumsum(counts, dtype=np.int64) - counts
            held.append((places.flatten().to_numpy(), counts[row], flat[tk.expand(begin[row], counts[row].astype(np.int64))]))
            if sum(len(h[0]) for h in held) >= _LIST_ROWS:
                yield _by_batch(held)
                held = []
        if held:
            yield _by_batch(held)

    return met.select("word", "places").mapInArrow(run, "batch long, steps array<int>, counts array<int>, ids array<smallint>")


def _by_batch(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row per batch of places with their counts and ids, words in order of their number.

    Ids go as pairs of 16 bits where a vocabulary needs more, so they are lists of small numbers in any case.
    """
    place, counts, flat = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(place, kind="stable")
    begin = np.cumsum(counts, dtype=np.int64) - counts
    place, counts, flat = place[order], counts[order], flat[tk.expand(begin[order], counts[order].astype(np.int64))]
    batch, code = place >> _CODE_BITS, (place & ((1 << _CODE_BITS) - 1)).astype(np.int32)
    first = np.flatnonzero(np.append(True, batch[1:] != batch[:-1])) if len(batch) else np.zeros(0, np.int64)
    steps = np.diff(code, prepend=np.int32(0))
    steps[first] = code[first]
    ends = np.append(first, len(batch))
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[ends]
    halves = np.ascontiguousarray(flat, "<i4").view("<i2").reshape(-1, 2)
    wide = np.maximum.reduceat((flat >> 16) != 0, before[:-1]) if len(first) and len(flat) else np.zeros(len(first), bool)
    low = [halves[x:y].reshape(-1) if w else halves[x:y, 0] for x, y, w in zip(before[:-1].tolist(), before[1:].tolist(), wide.tolist(), strict=True)]
    sizes = np.cumsum([0, *map(len, low)])
    one = lambda offs, values: pa.ListArray.from_arrays(pa.array(np.asarray(offs).astype(np.int32)), pa.array(values))
    cols = [pa.array(batch[first]), one(ends, steps), one(ends, counts), one(sizes, np.concatenate([*low, np.zeros(0, np.int16)]))]
    return pa.RecordBatch.from_arrays(cols, names=["batch", "steps", "counts", "ids"])


def _ids_of(small: np.ndarray, n: int) -> np.ndarray:
    """The ids of one list of small numbers: one each, or two where there are twice as many as ids."""
    if len(small) == 2 * n:
        return np.ascontiguousarray(small).view("<i4")
    return small.view("<u2").astype(np.int32)


def _words_of(rows: pa.Table, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Ids of a batch's words in one array, where each word's begin, its bytes by the token table, and the row of word number k."""
    none = [np.zeros(0, np.int32)]
    codes = np.concatenate([np.cumsum(x.values.to_numpy()) for x in rows.column("steps")] + none).astype(np.int64)
    per = [x.values.to_numpy() for x in rows.column("counts")]
    counts = np.concatenate([*per, *none]).astype(np.int32)
    flat = np.concatenate([_ids_of(x.values.to_numpy(), int(c.sum())) for x, c in zip(rows.column("ids"), per, strict=True)] + none)
    place = np.empty(len(codes), np.int64)
    place[codes] = np.arange(len(codes))
    begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    parts = pa.LargeListArray.from_arrays(pa.array(begin), tokens.take(pa.array(flat)))
    return flat, begin, pc.binary_join(parts, pa.scalar(b"", pa.large_binary())).to_pylist(), place


def byte_bpe(docs: DataFrame, rank_path: str, pattern: str, batch_rows: int = 50_000, batch_bytes: int = 28 << 20) -> DataFrame:
    """``doc_id, ids, decoded`` of every document.

    ``batch_rows``, ``batch_bytes``: bounds of a batch, which one task must hold; the result is the same for any.
    """
    return _laid_out(docs, rank_path, pattern, batch_rows, batch_bytes, digest=False)


def byte_bpe_digest(docs: DataFrame, rank_path: str, pattern: str, batch_rows: int = 50_000, batch_bytes: int = 28 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: as ``byte_bpe``, hashed where the ids are laid out."""
    return _laid_out(docs, rank_path, pattern, batch_rows, batch_bytes, digest=True)


def _laid_out(docs: DataFrame, rank_path: str, pattern: str, batch_rows: int, batch_bytes: int, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    batches = bucketed(number_batches(docs, pattern, batch_rows, batch_bytes), "bpe-batches", "batch")
    words = batches.select("batch", F.posexplode("words").alias("code", "word")).select("word", F.shiftleft("batch", _CODE_BITS).bitwiseOR(F.col("code").cast("long")).alias("place"))
    back = encode_words(words, rank_path, batches.count())
    table = {r["id"]: bytes(r["token"]) for r in token_table(spark, rank_path).toLocalIterator()}
    sent = spark.sparkContext.broadcast(pa.array([table.get(i) for i in range(max(table, default=-1) + 1)], pa.large_binary()))

    def digests(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, begin, decoded, place = _words_of(right, sent.value)
        flat = list(map(str, flat.tolist()))
        ids = [",".join(flat[a:b]).encode() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        rows = []
        for doc_id, part in _texts_of(left):
            part = place[part].tolist()
            text = b",".join([ids[k] for k in part])
            n = text.count(b",") + 1 if text else 0
            rows.append((doc_id, n, hashlib.sha256(text).hexdigest(), hashlib.sha256(b"".join([decoded[k] for k in part])).hexdigest()))
        return _as_table(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()])

    def lists(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, begin, decoded, place = _words_of(right, sent.value)
        rows = []
        for doc_id, part in _texts_of(left):
            part = place[part]
            rows.append((doc_id, flat[tk.expand(begin[part], begin[part + 1] - begin[part])], b"".join([decoded[k] for k in part.tolist()])))
        return _as_table(rows, ["doc_id", "ids", "decoded"], [pa.int64(), pa.list_(pa.int32()), pa.binary()])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"
    left = batches.select(F.col("batch").alias("of_batch"), "doc_ids", "counts", "codes")
    return left.groupBy("of_batch").cogroup(back.groupBy("batch")).applyInArrow(digests if digest else lists, schema)


def _as_table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _texts_of(left: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each text of a batch: its id and the numbers of its pre-tokens."""
    for row in left.to_pylist():
        codes = _unpack(row["codes"])
        at = 0
        for doc_id, n in zip(row["doc_ids"], row["counts"], strict=True):
            yield doc_id, codes[at : at + n]
            at += n
