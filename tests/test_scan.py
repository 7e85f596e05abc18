"""Folds in blocks against the plain folds, with blocks and run-ups of all sizes."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import align, scan

WORDS = "transcript_id int, word_idx long, text string, start_s double, end_s double"


def _words(seed, n=700):
    """Three transcripts; in one of them every word overlaps the one before, so that states reach far."""
    rng = random.Random(seed)
    rows = []
    for t, jump in ((1, 1.0), (2, 0.2), (3, 0.0)):
        at = 0.0
        for i in range(n if t < 3 else 90):
            start = round(at + rng.uniform(-jump, jump), 2) if t < 3 else round(5 - i * 0.01, 2)
            rows.append((t, i, f"w{i}", start, round(start + rng.uniform(-0.1, 0.6), 2)))
            at += 0.3
    return rows


def _clamped(rows, least=0.01):
    out, last = [], 0.0
    for t, i, w, start, end in rows:
        start = max(start, last)
        last = end = start + least if end < start else end
        out.append((t, i, w, start, end))
    return out


def _repaired(rows, least=0.02, shift=0.01):
    start, end = [r[3] for r in rows], [r[4] for r in rows]
    for i in range(len(rows)):
        if i and start[i] < end[i - 1]:
            middle = (start[i] + end[i - 1]) / 2
            end[i - 1] = start[i] = middle if middle >= start[i - 1] else start[i - 1] + shift
        end[i] = max(end[i], start[i] + least)
    return [(*r[:3], s, e) for r, s, e in zip(rows, start, end)]


@pytest.mark.parametrize("block, run_up", [(8192, 64), (7, 2), (16, 16), (5, 0)])
@pytest.mark.parametrize("operator, plain", [(align.clamp_order, _clamped), (align.repair_order, _repaired)])
def test_order_folds(spark, operator, plain, block, run_up):
    rows = _words(block)
    found = operator(spark.createDataFrame(rows, WORDS).repartition(5), block=block, run_up=run_up).orderBy("transcript_id", "word_idx").collect()
    assert [tuple(r) for r in found] == [w for t in (1, 2, 3) for w in plain([r for r in rows if r[0] == t])]


def _folded(parts):
    words, steps = [], []
    for k, part in enumerate(parts):
        n, rule = align.overlap_length(words, part)
        if k:
            steps.append((k, len(words), len(part), n, rule))
        words = words + part[n:]
    return words, steps


def _chunks(rng, timed):
    """Chunks that repeat the end of the last one, exactly or with other words, some shorter than what they repeat, some empty."""
    said = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(400)]
    parts, at = [], 0
    while at < len(said):
        n, back = rng.choice([1, 3, 12, 20, 20, 20]), rng.choice([0, 0, 1, 4, 8])
        a = max(0, at - back)
        part = [w if rng.random() > 0.06 else w + "x" for w in said[a : at + n]]
        parts.append([{"text": w, "start_s": (a + i) * 0.5, "end_s": (a + i) * 0.5 + 0.4} for i, w in enumerate(part)] if timed else part)
        at += n
        if rng.random() < 0.05:
            parts.append([])
    return parts


@pytest.mark.parametrize("timed", [False, True])
@pytest.mark.parametrize("block, run_up", [(64, 6), (4, 1), (3, 0)])
def test_stitching_equals_the_fold(spark, timed, block, run_up):
    rng = random.Random(block)
    parts = {t: _chunks(rng, timed) for t in (1, 2)} | {3: [[]], 4: [_chunks(rng, timed)[0]]}
    kind = "struct<text:string,start_s:double,end_s:double>" if timed else "string"
    given = spark.createDataFrame([(t, k, p) for t, own in parts.items() for k, p in enumerate(own)], f"transcript_id int, chunk int, words array<{kind}>").repartition(4)
    plain = (lambda r: r.asDict()) if timed else (lambda r: r)
    rows = {t: [] for t in parts}
    for r in align.stitched_words(given, block, run_up).orderBy("transcript_id", "word_idx").collect():
        assert r["word_idx"] == len(rows[r["transcript_id"]])
        rows[r["transcript_id"]].append(plain(r["word"]))
    assert rows == {t: _folded(own)[0] for t, own in parts.items()}
    steps = sorted((r["transcript_id"], r["step"], r["n_left"], r["n_right"], r["skipped"], r["rule"]) for r in align.stitch_steps(given, block, run_up).collect())
    assert steps == sorted((t, *s) for t, own in parts.items() for s in _folded(own)[1])
    whole = {r["transcript_id"]: [plain(w) for w in r["words"]] for r in align.stitch_chunks(given, block, run_up).collect()}
    assert whole == rows


def test_a_long_transcript_is_many_blocks(spark):
    words = spark.range(200_000).select(F.lit(1).alias("transcript_id"), F.col("id").alias("word_idx"), F.lit("w").alias("text"), (F.col("id") * 0.3 + F.pmod(F.xxhash64("id"), F.lit(10)) * 0.1).alias("start_s")).withColumn("end_s", F.col("start_s") + 0.4)
    blocks = scan.blocks_of(words, "transcript_id", ["word_idx"], 8192, 64)
    sizes = [(r["lead"], r["n"]) for r in blocks.select("lead", F.size("items").alias("n")).collect()]
    assert len(sizes) == 25 and max(n for _, n in sizes) == 8192 + 64 and sum(n - lead for lead, n in sizes) == 200_000
    found = align.repair_order(words).orderBy("word_idx").collect()
    expected = _repaired([tuple(r) for r in words.orderBy("word_idx").collect()])
    assert [tuple(r) for r in found] == expected


def test_nothing_to_scan(spark):
    none = spark.createDataFrame([], WORDS)
    assert align.clamp_order(none).count() == 0 and align.repair_order(none).count() == 0
    assert align.stitched_words(spark.createDataFrame([], "transcript_id int, chunk int, words array<string>")).count() == 0
