"""Attempts to rewrite chunks, their table, and the order of names."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from colloquy.operators import attempts, redact

WORDS = "transcript_id int, word_idx long, text string, start_s double, end_s double, speaker string"


def _words(spark, transcripts=3, n=60):
    return spark.createDataFrame([(t, i, "Maria" if i % 20 == 7 else f"w{i}", i * 0.5, i * 0.5 + 0.4, "A") for t in range(transcripts) for i in range(n)], WORDS)


def _rewrite(placed, attempt):
    """Chunk 0 is right at once, chunk 1 at the third attempt, chunk 2 never."""
    bad = (F.col("chunk") >= 1) & ((F.col("chunk") == 2) | (F.lit(attempt) < 3))
    out = F.when(F.col("text") == "Maria", redact.REDACTED).when(bad, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    return placed.withColumn("new_text", out)


def _tried(spark, words):
    return attempts.attempts(words, _rewrite, lambda p: redact.validate_first_pass(p, 0.25), size=24, overlap=4, min_final=2)


def test_attempts_end_with_the_first_that_passes(spark):
    rows = _tried(spark, _words(spark)).collect()
    assert sorted((r["transcript_id"], r["chunk"], r["attempt"], r["passed"]) for r in rows) == sorted((t, c, a, p) for t in range(3) for c, a, p in [(0, 1, True), (1, 1, False), (1, 2, False), (1, 3, True), *((2, a, False) for a in (1, 2, 3, 4))])
    for r in rows:
        assert r["input_words"] == r["output_words"] == len(r["input"].split()) == r["to_word"] - r["from_word"] + 1
        assert r["from_s"] == r["from_word"] * 0.5 and r["reason"] == ("ok" if r["passed"] else "changed_words")
    last = {(r["transcript_id"], r["chunk"]): r for r in attempts.last_words(_tried(spark, _words(spark, 1))).collect()}
    assert [last[0, c]["attempts"] for c in range(3)] == [1, 3, 4] and last[0, 0]["text"].split()[7] == redact.REDACTED and last[0, 2]["text"].split()[0] == "w40"


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_running_a_chunk_again_changes_one_partition(spark, tmp_path):
    path = str(tmp_path / "attempts")
    rows = _tried(spark, _words(spark))
    attempts.write_attempts(rows, path)
    before, old = _files(path), {(r["transcript_id"], r["chunk"], r["attempt"]): r["output"] for r in attempts.read_attempts(rows, path).collect()}
    again = rows.where("transcript_id = 1 AND chunk = 1 AND attempt = 1").withColumn("output", F.lit("new")).withColumn("passed", F.lit(True))
    attempts.write_attempts(again, path)
    after = _files(path)
    assert {p for p in set(before) | set(after) if before.get(p) != after.get(p)} and all("pass=1/chunk=1/" in p for p in set(before) | set(after) if before.get(p) != after.get(p))
    found = {(r["transcript_id"], r["chunk"], r["attempt"]): r["output"] for r in attempts.read_attempts(rows, path).collect()}
    assert found == {k: v for k, v in old.items() if k[:2] != (1, 1)} | {(1, 1, 1): "new"}


def test_no_words_no_attempts(spark):
    assert _tried(spark, _words(spark).where("word_idx < 0")).count() == 0


def test_names_are_ranked_whatever_they_begin_with(spark):
    rng = random.Random(4)
    names = [f"A{i:04d}" for i in range(800)] + ["Bo", "bo", "BO", "Cy"]
    rows = [(i % 7, i, n, "s") for i, n in enumerate(rng.sample(names, len(names)))]
    found = redact.global_names(spark.createDataFrame(rows, "transcript_id int, word_idx long, original string, speaker string")).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 803))
    assert found[0]["norm_name"] == "bo" and found[0]["occurrences"] == 3 and [r["norm_name"] for r in found[1:]] == sorted({n.lower() for n in names} - {"bo"})
