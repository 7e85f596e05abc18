"""Redaction in two passes over tables, with any rewriter of chunks in place of a language model.

A rewriter takes chunks of words (``transcript_id, chunk, i, text`` and further columns) and adds ``new_text``. A chunk whose
rewriting does not pass its check stays as it was. Where chunks overlap, the first one that has a word decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.config import REDACTED
from colloquy.operators import chunks, redact
from colloquy.operators.segments import joined

Rewriter = Callable[[DataFrame], DataFrame]


def _checked(rewritten: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    text = lambda c: joined(F.collect_list(F.struct("i", F.col(c).alias("text"))))
    pairs = rewritten.groupBy("transcript_id", "chunk").agg(text("text").alias("original"), text("new_text").alias("processed"))
    return rewritten.join(check(pairs).select("transcript_id", "chunk", "passed"), ["transcript_id", "chunk"])


def _decided(checked: DataFrame, overlap: int) -> DataFrame:
    kept = checked.where((F.col("chunk") == 0) | (F.col("i") >= overlap))
    out = F.when(F.col("passed"), F.col("new_text")).otherwise(F.col("text"))
    return kept.withColumn("original", F.col("text")).withColumn("text", out).withColumn("replaced", (F.col("text") == REDACTED) & (F.col("original") != REDACTED)).drop("new_text", "i")


def first_pass(words: DataFrame, rewrite: Rewriter, size: int = 400, overlap: int = 70, min_final: int = 200, limit: float = 0.10) -> DataFrame:
    """Words after the first pass: ``text`` as decided, ``original``, ``replaced``, and whether their ``chunk`` ``passed``."""
    placed = chunks.chunk_words(words, size, overlap, min_final)
    return _decided(_checked(rewrite(placed), lambda p: redact.validate_first_pass(p, limit)), overlap)


def text_pass(words: DataFrame, rewrite: Rewriter, size: int = 400, overlap: int = 70, min_final: int = 200, limit: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """For plain texts: the merged text per transcript, and the replacements of all chunks (those in overlaps count twice)."""
    checked = _checked(rewrite(chunks.chunk_words(words, size, overlap, min_final)), lambda p: redact.validate_first_pass(p, limit))
    text = _decided(checked, overlap).groupBy("transcript_id").agg(joined(F.collect_list(F.struct("word_idx", "text"))).alias("text"))
    found = checked.where(F.col("passed") & (F.col("new_text") == REDACTED)).select("transcript_id", "chunk", "word_idx", F.col("text").alias("original"))
    return text, found


def second_pass(words: DataFrame, names: DataFrame, rewrite: Callable[[DataFrame, DataFrame], DataFrame] = redact.redact_listed, size: int = 400, overlap: int = 70, min_final: int = 200, limit: float = 0.02) -> DataFrame:
    """Words of the first pass, each speaker's rewritten by the names found in all transcripts; without names they stay."""
    given = words.select("transcript_id", "word_idx", "speaker", "text", *(c for c in ("start_s", "end_s") if c in words.columns))
    own = Window.partitionBy("transcript_id", "speaker").orderBy("word_idx")
    keyed = given.select(F.struct("transcript_id", "speaker").alias("transcript_id"), (F.row_number().over(own) - 1).cast("long").alias("word_idx"), F.col("word_idx").alias("at"), *(c for c in given.columns if c not in ("transcript_id", "word_idx", "speaker")))
    decided = _decided(_checked(rewrite(chunks.chunk_words(keyed, size, overlap, min_final), names), lambda p: redact.validate_second_pass(p, limit)), overlap)
    return decided.select("transcript_id.transcript_id", F.col("at").alias("word_idx"), "transcript_id.speaker", *(c for c in decided.columns if c not in ("transcript_id", "word_idx", "at", "speaker")))


def two_passes(words: DataFrame, rewrite: Rewriter, size: int = 400, overlap: int = 70, min_final: int = 200, limits: tuple[float, float] = (0.10, 0.02)) -> DataFrame:
    """Both passes: words with their last ``text``, their ``original``, and the ``pass`` that redacted them (null: none)."""
    one = first_pass(words, rewrite, size, overlap, min_final, limits[0])
    found = one.where("replaced").select("transcript_id", "word_idx", "speaker", "original")
    two = second_pass(one, redact.global_names(found), size=size, overlap=overlap, min_final=min_final, limit=limits[1])
    before = one.select("transcript_id", "word_idx", "original", F.col("replaced").alias("first"))
    both = two.drop("original").join(before, ["transcript_id", "word_idx"])
    return both.select("transcript_id", "word_idx", "speaker", "text", "original", F.when(F.col("first"), 1).when(F.col("replaced"), 2).alias("pass"))


def audit_lines(replacements: DataFrame, words: DataFrame, before: int = 5, after: int = 3) -> DataFrame:
    """``transcript_id, word_idx, line, context`` per replacement: its time, the word and its speaker; rows with a null time name the place."""
    around = redact.context(words.join(replacements.select("transcript_id", "word_idx", F.lit(True).alias("replaced")), ["transcript_id", "word_idx"], "left").na.fill(False, ["replaced"]), before, after)
    t = F.col("start_s")
    seconds = F.format_string("%02d:%02d:%06.3f", F.floor(t / 3600).cast("int"), F.floor(F.pmod(t, F.lit(3600.0)) / 60).cast("int"), F.pmod(t, F.lit(60.0)))
    speaker = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit(", speaker: "), "speaker")).otherwise("")
    timed = F.format_string("[%s] [REDACTED] (word:\"%s\", word_index: %d%s)", seconds, "original", "word_idx", speaker)
    plain = F.format_string("[word_index: %d] [REDACTED] (word:\"%s\")", "word_idx", "original")
    rows = replacements.withColumn("line", F.when(t.isNull(), plain).otherwise(timed))
    return rows.join(around, ["transcript_id", "word_idx"], "left").select("transcript_id", "word_idx", "line", F.concat(F.lit("    Context: "), "context").alias("context"))


def audit_log(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """``transcript_id, content`` of audit ``lines`` and ``totals`` (``transcript_id, n_words``): head, lines in order, summary."""
    both = F.concat_ws("\n", "line", "context")
    body = lines.groupBy("transcript_id").agg(F.count("*").alias("n"), joined(F.collect_list(F.struct("word_idx", both.alias("text"))), "\n").alias("body"))
    rows = totals.join(body, "transcript_id", "left").na.fill({"n": 0, "body": "No names were replaced."})
    rate = F.when(F.col("n_words") > 0, F.format_string("- Replacement rate: %.2f%%", F.col("n") / F.col("n_words") * 100.0))
    rule = F.lit("=" * 50)
    content = F.concat_ws("\n", F.lit("De-Identification Audit Log"), rule, F.format_string("Total names replaced: %d", "n"), rule, "body", rule, F.lit("Summary:"), F.format_string("- Total words processed: %,d", "n_words"), F.format_string("- Names replaced: %d", "n"), rate)
    return rows.select("transcript_id", content.alias("content"))
