"""Timings for words: even and length-proportional alignment, interpolation, repair of order, and stitching of chunks.

Folds that depend on what came before run in blocks that agree at their borders (``scan``), so that no task holds a transcript.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import scan
from colloquy.operators.word_alignment import align_all, letter_bags, letters_shared
from colloquy.work import materialise


def even_alignment(texts: DataFrame, seconds_per_word: float = 0.5) -> DataFrame:
    """Words of ``text`` spread evenly over ``start_s`` and ``duration_s`` (or ``seconds_per_word`` each)."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = texts.withColumn("n", F.size(words)).select("*", F.posexplode(words).alias("word_idx", "word"))
    step = F.coalesce(F.col("duration_s") / F.col("n"), F.lit(seconds_per_word))
    start = F.col("start_s") + F.col("word_idx") * step
    return rows.select("transcript_id", "word_idx", "word", F.round(start, 6).alias("start_s"), F.round(start + step, 6).alias("end_s"))


def proportional_alignment(words: DataFrame, least_ms: float = 100.0) -> DataFrame:
    """Time by the length of words over ``total_ms``, ``least_ms`` at least each."""
    own = Window.partitionBy("transcript_id")
    share = F.greatest(F.lit(least_ms), F.length("text") / F.sum(F.length("text")).over(own) * F.col("total_ms"))
    end = F.sum("ms").over(own.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = words.withColumn("ms", share).withColumn("end_ms", end)
    seconds = lambda ms: F.round(ms / 1000 + 1e-9, 2)  # noqa: E731  halves go up, whatever the order of the sums
    return rows.select("transcript_id", "word_idx", "text", seconds(F.col("end_ms") - F.col("ms")).alias("start_s"), seconds(F.col("end_ms")).alias("end_s"))


def interpolate(gaps: DataFrame, least: float = 0.02) -> DataFrame:
    """``words`` spread evenly between ``prev_end`` and ``next_start``; without room each gets ``least`` seconds."""
    rows = gaps.withColumn("n", F.size("words")).select("*", F.posexplode("words").alias("i", "word"))
    room = F.col("next_start") - F.col("prev_end")
    step = F.when(room > 0, room / F.col("n")).otherwise(least)
    start = F.col("prev_end") + F.col("i") * step
    return rows.select("gap_id", "i", "word", F.round(start, 6).alias("start_s"), F.round(start + step, 6).alias("end_s"))


_TIMES = ("transcript_id", "word_idx", "text", "start_s", "end_s")


def _clamp(least: float) -> scan.Fold:
    def fold(rows: list[dict], last: float | None) -> tuple[list[dict], float | None]:
        out = []
        for w in rows:
            start = max(w["start_s"], last or 0.0)
            last = start + least if w["end_s"] < start else w["end_s"]
            out.append({"start_s": start, "end_s": last})
        return out, last

    return fold


def clamp_order(words: DataFrame, least: float = 0.01, block: int = 8192, run_up: int = 64) -> DataFrame:
    """Starts no word before the last one's end; a word that would end before it starts ends ``least`` later.

    The end of the word before is all that is carried on, so transcripts of any length run in blocks (``scan.carried_scan``).
    """
    done = scan.carried_scan(words.select(*_TIMES), "transcript_id", ["word_idx"], _clamp(least), "double", "struct<start_s:double,end_s:double>", block, run_up)
    return scan.scanned_rows(done, [*(f"item.{c}" for c in _TIMES[:3]), "out.start_s", "out.end_s"])


def _repair(least: float, shift: float) -> scan.Fold:
    """Outputs hold ``cut``: where the word before has to end, if this one overlaps it."""

    def fold(rows: list[dict], last: dict | None) -> tuple[list[dict], dict | None]:
        out = []
        for w in rows:
            start, cut = w["start_s"], None
            if last is not None and start < last["end_s"]:
                middle = (start + last["end_s"]) / 2
                start = cut = middle if middle >= last["start_s"] else last["start_s"] + shift
            last = {"start_s": start, "end_s": max(w["end_s"], start + least)}
            out.append(last | {"cut": cut})
        return out, last

    return fold


def repair_order(words: DataFrame, least: float = 0.02, shift: float = 0.01, block: int = 8192, run_up: int = 64) -> DataFrame:
    """Makes times monotone: an overlap is cut at its middle (not before the last start), and no word is shorter than ``least``.

    Blocks of words as in ``clamp_order``; the last word of a block ends where the first one of the next block cuts it.
    """
    kind = "struct<start_s:double,end_s:double,cut:double>"
    done = scan.carried_scan(words.select(*_TIMES), "transcript_id", ["word_idx"], _repair(least, shift), "struct<start_s:double,end_s:double>", kind, block, run_up)
    done = materialise(done, "repaired")
    heads = done.select("transcript_id", (F.col("block") - 1).alias("block"), F.col("out")[0]["cut"].alias("next_cut"))
    cut = lambda i: F.when(i + 1 < F.size("out"), F.get("out", i + 1)["cut"]).otherwise(F.col("next_cut"))
    ends = F.transform("out", lambda x, i: F.struct(x["start_s"].alias("start_s"), F.coalesce(cut(i), x["end_s"]).alias("end_s")))
    out = done.join(heads, ["transcript_id", "block"], "left").withColumn("out", ends)
    return scan.scanned_rows(out, [*(f"item.{c}" for c in _TIMES[:3]), "out.start_s", "out.end_s"])


def repair_report(words: DataFrame, repaired: DataFrame) -> DataFrame:
    """Words whose times a repair has changed, with the old times, the new ones, and by how much the start moved."""
    after = repaired.select("transcript_id", "word_idx", F.col("start_s").alias("new_start_s"), F.col("end_s").alias("new_end_s"))
    both = words.select("transcript_id", "word_idx", "text", "start_s", "end_s").join(after, ["transcript_id", "word_idx"])
    return both.where("start_s <> new_start_s OR end_s <> new_end_s").withColumn("moved_s", F.round(F.col("new_start_s") - F.col("start_s"), 6))


def fill_unknown(pairs: DataFrame) -> DataFrame:
    """``aligned`` words with ``<unk>`` filled from ``original`` ones by two pointers in order; both are arrays of a row."""

    @F.pandas_udf("array<string>")
    def merge(aligned: pd.Series, original: pd.Series) -> pd.Series:
        def one(a: Sequence[str], b: Sequence[str]) -> list[str]:
            out, at = [], 0
            for word in a:
                if word == "<unk>" and at < len(b):
                    out.append(b[at])
                    at += 1
                else:
                    out.append(word)
                    at += at < len(b) and word.lower() == b[at].lower()
            return out

        return pd.Series([one(a, b) for a, b in zip(aligned, original, strict=True)])

    return pairs.withColumn("filled", merge("aligned", "original"))


# --- stitching of overlapping chunks --------------------------------------------------------------


@lru_cache(1 << 16)
def _alike(a: str, b: str, ratio: float = 0.7) -> bool:
    """Whether two words in lower case are alike; what their lengths alone or shared letters rule out is not compared."""
    if a == b:
        return True
    m = difflib.SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio


def _share_alike(a: Sequence[str], b: Sequence[str], share: float) -> bool:
    """Whether at least ``share`` of the pairs are alike; stops once too many are not."""
    different, most = 0, len(a) - share * len(a)
    for x, y in zip(a, b, strict=True):
        different += not _alike(x, y)
        if different > most + 1e-9:
            return False
    return True


def _long_enough(end: Sequence[str], begin: Sequence[str], share: float) -> list[int]:
    """Lengths, longest first, at which the end of one list may repeat the beginning of the other; ``_share_alike`` fails at all others.

    Words that are alike share 0.7 of their letters, and counts of letters by bucket are never less than what is shared; so of all lengths
    only those are held word by word where enough pairs may be alike.
    """
    most = len(end)
    lengths, bags = letter_bags([*end, *begin])
    both = np.maximum(lengths[:most, None] + lengths[None, most:], 1)
    likely = (2.0 * letters_shared(bags[:most], bags[most:]) / both >= 0.7) | (both <= 1)
    i, j = np.nonzero(likely)
    n = np.arange(1, most + 1)
    different = n - np.bincount((most - (i - j))[i >= j], minlength=most + 1)[1:]
    return n[(different <= n - share * n + 1e-9) | (different == 0)][::-1].tolist()


def _partly(a: str, b: str) -> bool:
    """Whether one word may be the cut-off form of the other: within one over 1.5 times as long, or the same half at an end."""
    short, long = sorted((a.lower(), b.lower()), key=len)
    if len(long) > 1.5 * len(short) and short in long:
        return True
    half = len(short) // 2
    return bool(short) and (long[:half] == short[:half] or long[len(long) - half :] == short[len(short) - half :])


def _blocks(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """Runs of equal words ``begin in a, begin in b, length`` in order."""
    return [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks() if m.size]


def _by_times(left: Sequence[dict], right: Sequence[dict], buffer: float) -> int:
    """Words of ``right`` to leave out by the longest run, of two words at least, that the overlapping times share."""
    last = left[-1]["end_s"]
    if right[0]["start_s"] >= last:
        return 0
    begin = next((i for i, w in enumerate(left) if w["start_s"] >= right[0]["start_s"] - buffer), len(left))
    stop = next((i for i, w in enumerate(right) if w["end_s"] > last + buffer), len(right))
    a, b = ([w["text"].lower() for w in part] for part in (left[begin:], right[:stop]))
    runs = [m for m in _blocks(a, b) if m[2] >= 2 and m[0] + m[2] >= len(a) - 1]
    found = max(runs, key=lambda m: m[2], default=(0, 0, 0))
    return found[1] + found[2]


def _by_sequence(tail: Sequence[str], head: Sequence[str]) -> int:
    """Words of ``head`` to leave out by runs that end with ``tail``: one that is long enough, else several with gaps of two at most."""
    least = min(3, max(2, len(tail) // 3))
    runs = _blocks(tail, head)
    long = [m for m in runs if m[2] >= least and m[0] + m[2] >= len(tail) - 1]
    if long:
        found = max(long, key=lambda m: (m[0] + m[2], m[2]))
        return found[1] + found[2]
    for i in range(len(runs)):
        words, end, skip = runs[i][2], runs[i][0] + runs[i][2], runs[i][1] + runs[i][2]
        for at, other, n in runs[i + 1 :]:
            if at <= end + 2:
                words, end, skip = words + n, at + n, other + n
        if end >= len(tail) - 1 and words >= least:
            return skip
    return 0


def overlap_length(left: Sequence, right: Sequence, share: float = 0.6, window: int = 20, buffer: float = 0.5) -> tuple[int, str]:
    """How many words of ``right`` repeat the end of ``left``, and by which rule that was found.

    Words are texts, or mappings of ``text, start_s, end_s``; with times, their overlap comes first.
    """
    if not left or not right:
        return 0, "none"
    if not isinstance(left[0], str):
        n = _by_times(left, right, buffer)
        if n:
            return n, "temporal"
        left, right = [w["text"] for w in left], [w["text"] for w in right]
    most = min(len(left), len(right))
    end, begin = [w.lower() for w in left[len(left) - most :]], [w.lower() for w in right[:most]]
    for n in _long_enough(end, begin, share):
        a, b = end[most - n :], begin[:n]
        if a == b:
            return n, "exact"
        if _share_alike(a, b, share):
            return n, "fuzzy"
    if _partly(left[-1], right[0]):
        return 1, "partial"
    if most >= 2 and _partly(left[-2], right[0]) and _alike(left[-1].lower(), right[1].lower()):
        return 2, "partial"
    n = _by_sequence([w.lower() for w in left[-window:]], [w.lower() for w in right[:window]])
    return (n, "sequence") if n else (0, "none")


def _stitch(reach: int) -> scan.Fold:
    """Carries on the last ``reach`` words of what was stitched: rules of overlap look no further back."""

    def fold(rows: list[dict], tail: list | None) -> tuple[list[dict], list | None]:
        out = []
        for row in rows:
            part = row["words"] or []
            n, rule = overlap_length(tail or [], part)
            out.append({"skipped": n, "rule": rule})
            tail = [*(tail or []), *part[n:]][-reach:]
        return out, tail

    return fold


def _seams(chunks: DataFrame, block: int, run_up: int) -> DataFrame:
    """``transcript_id, chunk, words, skipped, rule, before``: what each chunk repeats, and the words stitched before it."""
    kind = chunks.schema["words"].dataType.simpleString()
    given = materialise(chunks.select("transcript_id", "chunk", "words"), "chunks")
    longest = given.agg(F.max(F.size("words"))).first()[0] or 1
    reach = max(2 * longest, 40)
    done = scan.carried_scan(given, "transcript_id", ["chunk"], _stitch(reach), kind, "struct<skipped:int,rule:string>", block, run_up, written=True)
    rows = scan.scanned_rows(done.withColumn("items", F.transform("items", lambda x: x.withField("block", F.col("block")))), ["item.transcript_id", "item.block", "item.chunk", "item.words", "out.skipped", "out.rule"])
    rows = materialise(rows.withColumn("added", F.size("words") - F.col("skipped")), "seams")
    # Words before a chunk: those before its block, by one row a block, and those of its block.
    sums = rows.groupBy("transcript_id", "block").agg(F.sum("added").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("transcript_id", "block", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("transcript_id").orderBy("block"))), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("added").over(earlier(Window.partitionBy("transcript_id", "block").orderBy("chunk"))), F.lit(0))
    placed = rows.withColumn("inside", inside).join(offsets, ["transcript_id", "block"])
    return placed.select("transcript_id", "chunk", "words", "skipped", "rule", (F.col("offset") + F.col("inside")).alias("before"))


def stitched_words(chunks: DataFrame, block: int = 64, run_up: int = 6) -> DataFrame:
    """``transcript_id, word_idx, word`` of ``transcript_id, chunk, words``: chunks in order, without what they repeat.

    ``words`` are texts or structs with ``text, start_s, end_s``. Each chunk is held against the end of what was stitched before it: its last
    words, twice the longest chunk's number, are carried from chunk to chunk (``scan.carried_scan``), and
    running sums of what is left place the words. Times that overlap are looked for within those words.
    """
    seams = _seams(chunks, block, run_up)
    rest = F.slice("words", F.col("skipped") + 1, F.size("words"))
    return seams.select("transcript_id", "before", F.posexplode(rest).alias("i", "word")).select("transcript_id", (F.col("before") + F.col("i")).alias("word_idx"), "word")


def stitch_chunks(chunks: DataFrame, block: int = 64, run_up: int = 6) -> DataFrame:
    """``transcript_id, words, skipped``: ``stitched_words`` with each transcript as one row."""
    seams = _seams(chunks, block, run_up)
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.slice("words", F.col("skipped") + 1, F.size("words")).alias("rest"))))
    return seams.groupBy("transcript_id").agg(F.flatten(F.transform(parts, lambda x: x["rest"])).alias("words"), F.sum("skipped").alias("skipped"))


def stitch_steps(chunks: DataFrame, block: int = 64, run_up: int = 6) -> DataFrame:
    """``transcript_id, step, chunk, n_left, n_right, skipped, rule`` of each step of ``stitch_chunks``, for audits."""
    first = F.min("chunk").over(Window.partitionBy("transcript_id"))
    rows = _seams(chunks, block, run_up).withColumn("first", first)
    return rows.where("chunk > first").select("transcript_id", (F.col("chunk") - F.col("first")).alias("step"), "chunk", F.col("before").alias("n_left"), F.size("words").cast("long").alias("n_right"), F.col("skipped").cast("long").alias("skipped"), "rule")


def tail_window(text: Column, words: int = 100) -> tuple[Column, Column]:
    """An array of words as what goes before and the last ``words`` of it, which alone are sent on to a stitcher."""
    n = F.size(text)
    return F.slice(text, F.lit(1), F.greatest(n - words, F.lit(0))), F.slice(text, F.greatest(n - words, F.lit(0)) + 1, F.lit(words))


def stitch_methods(pairs: DataFrame) -> DataFrame:
    """Rule and length of the overlap of each row's ``left`` and ``right`` words."""

    @F.arrow_udf("struct<n:int,rule:string>")
    def find(left: pa.Array, right: pa.Array) -> pa.Array:
        found = [overlap_length(a, b) for s, t in zip(slices(left), slices(right), strict=True) for a, b in zip(_word_lists(s), _word_lists(t), strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], names=["n", "rule"])

    return pairs.withColumn("overlap", find("left", "right")).select("*", "overlap.n", "overlap.rule").drop("overlap")


_PLACES = "array<struct<source_idx:int,target_idx:int>>"
_PLACES_TYPE = pa.list_(pa.struct([("source_idx", pa.int32()), ("target_idx", pa.int32())]))
_SLICE = 512  # rows of a batch that are held as Python objects at once


def _aligned() -> Column:
    @F.arrow_udf(_PLACES)
    def align(source: pa.Array, target: pa.Array) -> pa.Array:
        parts = [pa.array([], _PLACES_TYPE)]
        for s, t in zip(slices(source), slices(target), strict=True):
            found = list(align_all(list(zip(_word_lists(s), _word_lists(t), strict=True))))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            places = np.concatenate(found)
            parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(places[:, c]) for c in (0, 1)], names=["source_idx", "target_idx"])))
        return pa.concat_arrays([p.cast(_PLACES_TYPE) for p in parts])

    return align("source", "target")


def slices(column: pa.Array) -> Iterator[pa.Array]:
    return (column.slice(at, _SLICE) for at in range(0, len(column), _SLICE))


def _word_lists(column: pa.Array) -> list[list[str]]:
    return [words or [] for words in scan.plain(column)]


def aligned_pairs(rows: DataFrame) -> DataFrame:
    """``pos, source_idx, target_idx`` of the best alignment of each row's ``source`` and ``target`` words; -1 stands for a gap."""
    kept = [c for c in rows.columns if c not in ("source", "target")]
    return rows.select(*kept, F.posexplode(_aligned()).alias("pos", "p")).select(*kept, "pos", "p.*")


def dp_alignment(pairs: DataFrame) -> DataFrame:
    """``matched, source_gaps, target_gaps`` of the alignment of each row's ``source`` and ``target`` words."""
    rows = pairs.withColumn("a", _aligned())
    count = lambda rule: F.size(F.filter("a", rule))
    return rows.withColumns({
        "matched": count(lambda p: (p["source_idx"] >= 0) & (p["target_idx"] >= 0)),
        "source_gaps": count(lambda p: p["target_idx"] < 0),
        "target_gaps": count(lambda p: p["source_idx"] < 0),
    }).drop("a")


def with_original_text(texts: DataFrame) -> DataFrame:
    """``word_idx, text, start_s, end_s`` of the words of ``original`` (a text), timed by ``aligned`` (structs ``text, start_s, end_s``).

    Rows: ``transcript_id, original, aligned, start_s, end_s`` of a segment. Equal counts are zipped; else both are aligned by
    similarity: further aligned words widen the word before them, unmatched originals share the room between their neighbours.
    """
    kind = "array<struct<text:string,start_s:double,end_s:double>>"

    @F.arrow_udf(kind)
    def timed(original: pa.Array, aligned: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        parts = [pa.array([], _TIMED_TYPE)]
        for columns in zip(*map(slices, (original, aligned, start, end)), strict=True):
            texts, *times = map(scan.plain, columns)
            parts.append(_timed_lists(list(originals_with_times([a.split() for a in texts], *times))))
        return pa.concat_arrays(parts)

    # exploded where it is made: of a column Spark would ask first whether it is empty, and run the function twice
    words = timed(F.coalesce("original", F.lit("")), F.coalesce("aligned", F.array().cast(kind)), "start_s", "end_s")
    return texts.select("transcript_id", F.posexplode(words).alias("word_idx", "w")).select("transcript_id", "word_idx", "w.*")


def _timed_lists(rows: list[list[dict]]) -> pa.Array:
    """The lists as Arrow has them, from columns."""
    ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    fields = [pa.array([w[f.name] for row in rows for w in row], f.type) for f in _TIMED_TYPE.value_type]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["text", "start_s", "end_s"])).cast(_TIMED_TYPE)


_TIMED_TYPE = pa.list_(pa.struct([("text", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def _spread(words: list[str], start: float, end: float, least: float = 0.02) -> list[dict]:
    step = (end - start) / len(words) if end > start else least
    return [{"text": w, "start_s": start + i * step, "end_s": start + (i + 1) * step} for i, w in enumerate(words)]


def originals_with_times(original: list[list[str]], aligned: list[list[dict]], start: list[float], end: list[float]) -> Iterator[list[dict]]:
    """Segments one by one; those whose counts differ are aligned side by side."""
    uneven = [k for k, (a, b) in enumerate(zip(original, aligned, strict=True)) if len(a) != len(b)]
    places = dict(zip(uneven, align_all([(original[k], [w["text"] for w in aligned[k]]) for k in uneven]), strict=True))
    for k, row in enumerate(zip(original, aligned, start, end, strict=True)):
        yield _with_times(*row, places[k].tolist() if k in places else None)


def original_with_times(original: list[str], aligned: list[dict], start: float, end: float) -> list[dict]:
    return next(originals_with_times([original], [aligned], [start], [end]))


def _with_times(original: list[str], aligned: list[dict], start: float, end: float, places: list[list[int]] | None) -> list[dict]:
    if places is None:
        return [{"text": w, "start_s": a["start_s"], "end_s": a["end_s"]} for w, a in zip(original, aligned, strict=True)]
    out: list[dict] = []
    open_words: list[str] = []
    last = start
    behind = False  # whether aligned words widen the last word of ``out``
    for i, j in places:
        if i >= 0 and j >= 0:
            if open_words:
                out += _spread(open_words, last, aligned[j]["start_s"])
                open_words = []
            out.append({"text": original[i], "start_s": aligned[j]["start_s"], "end_s": aligned[j]["end_s"]})
            last, behind = aligned[j]["end_s"], True
        elif i >= 0:
            open_words.append(original[i])
            behind = False
        elif behind:
            out[-1]["end_s"] = last = aligned[j]["end_s"]
    return out + (_spread(open_words, last, end) if open_words else [])


def word_spans(texts: DataFrame, ahead: int = 10) -> DataFrame:
    """``transcript_id, word_idx, text, start_s, end_s`` of the words of ``text`` from ``spans`` of characters.

    ``spans``: array of ``char, start_ms, end_ms``, in order, ``|`` between words. Letters and digits are matched one by one, without
    regard to case; a character that is missing is looked for up to ``ahead`` places on. A word without any match begins where
    the one before ends and takes 150 ms a character, 200 ms at least.
    """

    @F.pandas_udf("array<struct<text:string,start_s:double,end_s:double>>")
    def timed(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([words_from_characters(t.split(), list(s), ahead) for t, s in zip(text, spans, strict=True)])

    kind = "array<struct<char:string,start_ms:double,end_ms:double>>"
    words = timed(F.coalesce("text", F.lit("")), F.coalesce("spans", F.array().cast(kind)))
    return texts.select("transcript_id", F.posexplode(words).alias("word_idx", "w")).select("transcript_id", "word_idx", "w.*")


def words_from_characters(words: list[str], spans: list[dict], ahead: int = 10) -> list[dict]:
    out: list[dict] = []
    at = 0
    for word in words:
        wanted = [c for c in word.upper() if c.isalnum()]
        own: list[dict] = []
        k = 0
        while at < len(spans) and k < len(wanted):
            if spans[at]["char"] == "|":
                at += 1
            elif spans[at]["char"].upper() == wanted[k]:
                own.append(spans[at])
                k, at = k + 1, at + 1
            else:
                near = range(at + 1, min(at + ahead, len(spans)))
                hit = next((i for i in near if spans[i]["char"] != "|" and spans[i]["char"].upper() == wanted[k]), None)
                if hit is None:
                    k, at = k + 1, at + 1
                else:
                    at = hit
        if own:
            start, end = min(s["start_ms"] for s in own), max(s["end_ms"] for s in own)
        else:
            start = out[-1]["end_s"] * 1000 if out else 0.0
            end = start + max(len(word) * 150, 200)
        out.append({"text": word, "start_s": round(start / 1000, 2), "end_s": round(end / 1000, 2)})
    return out


def word_diff(pairs: DataFrame) -> DataFrame:
    """Differences of each row's ``original`` and ``processed`` words: ``kind, a_from, a_to, b_from, b_to``."""
    kinds = "array<struct<kind:string,a_from:int,a_to:int,b_from:int,b_to:int>>"

    @F.pandas_udf(kinds)
    def diff(original: pd.Series, processed: pd.Series) -> pd.Series:
        def one(a: list[str], b: list[str]) -> list[tuple]:
            codes = difflib.SequenceMatcher(None, [w.lower() for w in a], [w.lower() for w in b]).get_opcodes()
            redacts = lambda k, j1, j2: k == "replace" and all("[REDACTED]" in w for w in b[j1:j2])
            return [("redact" if redacts(k, j1, j2) else k, i1, i2, j1, j2) for k, i1, i2, j1, j2 in codes if k != "equal"]

        return pd.Series([one(list(a), list(b)) for a, b in zip(original, processed, strict=True)])

    return pairs.withColumn("diff", diff.asNondeterministic()("original", "processed"))  # so that exploding it does not run it twice


def pack_sentences(texts: DataFrame, max_words: int = 500) -> DataFrame:
    """``sentences`` of each row in pieces of at most ``max_words`` words; a longer sentence is a piece of its own."""

    def step(acc, s):
        words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
        new = F.struct(F.array_append(acc["done"], acc["text"]).alias("done"), s.alias("text"), words.alias("n"))
        more = F.struct(acc["done"].alias("done"), F.when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit(" "), s)).alias("text"), (acc["n"] + words).alias("n"))
        return F.when((acc["n"] + words > max_words) & (acc["text"] != ""), new).otherwise(more)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))
    end = lambda acc: F.when(acc["text"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["text"]))
    return texts.withColumn("pieces", F.aggregate("sentences", start, step, end))
