"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

A test item that occurs in a text with at most ``e`` edits has, cut into ``e + 1`` pieces, at least one piece
that occurs there unchanged. ``e`` is ``error_rate`` of the item's length.

1. Items and their pieces are tables; a piece is known by a hash of its characters and its length. Of all pieces the tasks get a bit
   map of ``2 ** bits`` bits and the few lengths there are, whatever the size of the benchmark.
2. One map over the documents takes rolling hashes of all windows: of the first characters of pieces first, then, where those
   are in the bit map, of whole pieces. What is left, few documents, is written out with the text around the hits.
3. Hits join the pieces by hash and length, which gives an item and a place for it; then the item is verified with Myers'
   bit-parallel distance (one big integer per column), so nothing within the budget is missed and nothing beyond it is
   reported. What the bit map lets through wrongly finds no piece there, or fails the distance.

Texts and items are compared in lower case with white space as one blank; places are in that form of the text.

Edge cases: null and empty texts match nothing, and so do null and empty items; an item so short that its budget is 0 is
found where it stands unchanged between word borders. Repeated items or rows are reported each. An empty benchmark or
table gives no rows. Only ``doc_id, text`` and ``item_id, text`` are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import textkernel as tk
from colloquy.llm.shared import materialise, texts

SCHEMA = "doc_id long, item_id long, start_char long, end_char long, distance long"
_KEY = 8  # characters of a piece that are looked up first


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any stretch of ``text``, and where the first such stretch ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, where = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        rise = down | ~(horizontal | up) & full
        fall = up & horizontal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up = fall | ~(vertical | rise) & full
        down = rise & vertical
        if score < best:
            best, where = score, j
    return best, where


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a stretch neither begins nor ends inside a word."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(start) and not inside(end)


def places(text: str, item: str, budget: int, begins: list[int]) -> list[tuple[int, int, int]]:
    """``start, end, distance`` of each place where ``item`` stands within ``budget`` edits; it may begin about ``begins``."""
    found = []
    done = -1
    for d in sorted(set(begins)):
        if d < done:
            continue
        if not budget:
            if d >= 0 and text.startswith(item, d) and _stands_alone(text, d, d + len(item)):
                found.append((d, d + len(item), 0))
                done = d + len(item)
            continue
        if d >= 0 and text.startswith(item, d):
            found.append((d, d + len(item), 0))
            done = d + len(item) - budget
            continue
        lo = max(0, d - budget)
        distance, stop = myers(item, text[lo : d + len(item) + budget])
        if distance <= budget:
            end = lo + stop
            back = text[max(0, end - len(item) - budget) : end]
            found.append((end - myers(item[::-1], back[::-1])[1], end, distance))
            done = end - budget
    return found


_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_SEGMENT = 1 << 21  # characters that are hashed at once
_BREAK = "\U0010ffff"  # between texts; no window with it is a piece


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


class _Windows:
    """Rolling hashes of all windows of a run of characters, of any length."""

    def __init__(self, chars: np.ndarray) -> None:
        self.n = n = len(chars)
        size = 1 << max(n, 2).bit_length()  # few different tables
        with np.errstate(over="ignore"):
            self.inverse = _powers(int(_INVERSE), size)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(tk.mix(chars.astype(np.uint64) + np.uint64(1)) * _powers(int(_POWER), size)[:n], out=self.sums[1:])

    def hashes(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of ``length`` at the places ``at`` (all that fit, by default)."""
        at = np.arange(max(self.n - length + 1, 0)) if at is None else at
        with np.errstate(over="ignore"):
            return tk.mix((self.sums[at + length] - self.sums[at]) * self.inverse[at] + np.uint64(length))


def _items(benchmark: DataFrame, error_rate: float) -> DataFrame:
    """``item, item_id, text, budget`` of the items in normal form; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [normal(t or "") for t in batch.column("text").to_pylist()]
            budget = pa.array([int(error_rate * len(t)) for t in text], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(text, pa.string()), budget], names=["item", "item_id", "text", "budget"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    numbered = materialise(rows.withColumn("item", F.monotonically_increasing_id()), "test-items")
    return materialise(numbered.select("item", "item_id", "text").mapInArrow(run, "item long, item_id long, text string, budget int").where("text <> ''"), "normal-items")


def _pieces(items: DataFrame) -> DataFrame:
    """``hash, length, key, item, at``: each item's pieces, with the hash of their first characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for item, text, budget in zip(*(batch.column(c).to_pylist() for c in ("item", "text", "budget")), strict=True):
                windows = _Windows(_chars(text))
                cuts = [p * windows.n // (budget + 1) for p in range(budget + 2)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    at = np.array([a])
                    values = windows.hashes(b - a, at).view(np.int64)[0], b - a, windows.hashes(min(_KEY, b - a), at).view(np.int64)[0], item, a
                    for col, value in zip(cols, values, strict=True):
                        col.append(int(value))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["hash", "length", "key", "item", "at"])

    return materialise(items.select("item", "text", "budget").mapInArrow(run, "hash long, length int, key long, item long, at int"), "pieces")


class _Filter:
    """Which hashes may be those of pieces: a bit map for first characters and whole pieces, and the lengths there are."""

    def __init__(self, pieces: DataFrame, bits: int) -> None:
        self.bits = bits
        self.map = np.zeros(1 << max(bits - 6, 0), np.uint64)
        place = lambda c: F.shiftrightunsigned(c, 64 - bits)
        both = pieces.select(F.explode(F.array("hash", "key")).alias("h")).select(place("h").alias("p"))
        words = both.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(pmod(p, 64) AS INT)))").alias("mask"))
        for r in words.toLocalIterator():  # bounded by the size of the map
            self.map[r["word"]] = np.int64(r["mask"]).view(np.uint64)
        self.lengths = sorted(r["length"] for r in pieces.select("length").distinct().collect())  # bounded by 2 / error_rate or so

    def may(self, hashes: np.ndarray) -> np.ndarray:
        p = hashes >> np.uint64(64 - self.bits)
        return (self.map[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text, ``hash, length, place`` of the windows that may be pieces; texts are hashed many at once, long ones in parts."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not self.lengths:
            return found
        chars = _chars(_BREAK.join(texts))
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        ends = starts + np.array([len(t) for t in texts], np.int64)
        for lo in range(0, len(chars), _SEGMENT):
            windows = _Windows(chars[lo : lo + _SEGMENT + self.lengths[-1] - 1])
            known: dict[int, np.ndarray] = {}
            for length in self.lengths:
                first = min(_KEY, length)
                if first not in known:
                    known[first] = np.flatnonzero(self.may(windows.hashes(first)))
                at = known[first]
                at = at[(at + length <= windows.n) & (at < _SEGMENT)]
                whole = windows.hashes(length, at)
                ok = self.may(whole)
                place = at[ok] + lo
                row = np.searchsorted(starts, place, "right") - 1
                inside = place + length <= ends[row]
                for r, h, p in zip(row[inside].tolist(), whole[ok][inside].view(np.int64).tolist(), (place - starts[row])[inside].tolist(), strict=True):
                    found[r].append((h, length, p))
        return found


_HITS = "array<struct<hash:bigint,length:int,place:int>>"


def _windows_with_hits(docs: DataFrame, sent, reach: int) -> DataFrame:
    """``doc_id, key, start, text, hits``: stretches of texts about hits, ``reach`` characters to both sides, joined where they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in tk.blocks(batch.column("text")):
                part = batch.slice(a, b - a)
                plain = [normal(t.as_py()) for t in part.column("text")]
                rows = []
                for doc_id, key, text, hits in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), plain, sent.value.hits(plain), strict=True):
                    spans: list[list] = []
                    for h in sorted(hits, key=lambda h: h[2]):
                        lo, hi = max(0, h[2] - reach), h[2] + h[1] + reach
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                            spans[-1][2].append(h)
                        else:
                            spans.append([lo, hi, [h]])
                    rows += [(doc_id, key, lo, text[lo:hi], [{"hash": h, "length": n, "place": p - lo} for h, n, p in own]) for lo, hi, own in spans]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("place", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "key", "start", "text", "hits"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id long, key string, start long, text string, hits {_HITS}")


def _text_key(text):
    """Equal for equal texts: what holds an item is a matter of the text alone."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _found(docs: DataFrame, benchmark: DataFrame, error_rate: float, bits: int) -> DataFrame | None:
    """``doc_id, key`` and the places of items; None without items."""
    items = _items(benchmark, error_rate)
    longest = items.select(F.max(F.length("text") + F.col("budget"))).first()[0]
    if longest is None:
        return None
    pieces = _pieces(items)
    sent = docs.sparkSession.sparkContext.broadcast(_Filter(pieces, bits))
    given = texts(docs).withColumn("key", _text_key(F.col("text")))
    windows = _windows_with_hits(given, sent, longest + 1).withColumn("window", F.monotonically_increasing_id())
    windows = materialise(windows, "hit-windows")
    hits = windows.select("window", F.explode("hits").alias("h")).select("window", "h.*")
    begins = hits.join(pieces.select("hash", "length", "item", "at"), ["hash", "length"]).select("window", "item", (F.col("place") - F.col("at")).alias("begin"))
    asked = materialise(begins.groupBy("window", "item").agg(F.collect_set("begin").alias("begins")), "asked-items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [(r["doc_id"], r["key"], r["item_id"], r["start"] + a, r["start"] + b, n) for a, b, n in places(r["text"], r["item_text"], r["budget"], r["begins"])]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "key", "item_id", "start_char", "end_char", "distance"])

    known = items.select("item", "item_id", F.col("text").alias("item_text"), "budget")
    rows = asked.join(known, "item").join(windows.drop("hits"), "window")
    return rows.select("doc_id", "key", "item_id", "item_text", "budget", "begins", "start", "text").mapInArrow(verify, "doc_id long, key string, item_id long, start_char long, end_char long, distance long")


def find_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, bits: int = 26) -> DataFrame:
    """One row per place of a test item in a document: ``doc_id, item_id, start_char, end_char, distance``."""
    found = _found(docs, benchmark, error_rate, bits)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found.drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, bits: int = 26) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with all their columns."""
    found = _found(docs, benchmark, error_rate, bits)
    if found is None:
        return docs
    keys = materialise(found.select(F.col("key").alias("_holds_item")).distinct(), "contaminated")  # written, so that its size decides the join
    return docs.join(keys, _text_key(docs["text"]) == keys["_holds_item"], "left_anti")
