"""Redaction of names: checks of a rewriter's output, replacements, name lists and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.config import REDACTED
from colloquy.functions.text import composed
from colloquy.operators.ordering import positions
from colloquy.work import materialise

# Quotation marks and the plain ones that they compare as.
_QUOTES = "‘’‚‛“”„‟«»‹›"
_PLAIN = "''''\"\"\"\"\"\"''"


def folded(text: Column) -> Column:
    """For comparing words: plain quotation marks and lower case, of texts in composed form (``composed``)."""
    return F.lower(F.translate(text, _QUOTES, _PLAIN))


def split_words(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def _is_redacted(word: Column) -> Column:
    return word.contains(REDACTED)


def validate_first_pass(pairs: DataFrame, limit: float = 0.10) -> DataFrame:
    """``passed, reason`` of a rewriting: equal word count, few redactions, other words untouched."""
    with_words = pairs.withColumns({"a": split_words(composed("original")), "b": split_words(composed("processed"))})
    redacted = F.size(F.filter("b", _is_redacted))
    changed = F.exists(F.arrays_zip("a", "b"), lambda z: ~_is_redacted(z["b"]) & (folded(z["a"]) != folded(z["b"])))
    reason = (
        F.when(F.size("a") != F.size("b"), "word_count")
        .when(redacted > F.size("a") * F.lit(limit), "too_many_redactions")
        .when(changed, "changed_words")
        .otherwise("ok")
    )
    return with_words.withColumn("reason", reason).withColumn("passed", F.col("reason") == "ok").withColumn("redacted", redacted).drop("a", "b")


def validate_second_pass(pairs: DataFrame, limit: float = 0.02) -> DataFrame:
    """``passed, reason``: equal word count, no redaction undone, few new ones. Other words are not compared."""
    with_words = pairs.withColumns({"a": split_words(F.col("original")), "b": split_words(F.col("processed"))})
    before, after = F.size(F.filter("a", _is_redacted)), F.size(F.filter("b", _is_redacted))
    reason = (
        F.when(F.size("a") != F.size("b"), "word_count")
        .when(after < before, "lost_redactions")
        .when(after - before > (F.size("a") - before) * F.lit(limit), "too_many_new")
        .otherwise("ok")
    )
    return with_words.withColumn("reason", reason).withColumn("passed", F.col("reason") == "ok").withColumn("new_redactions", after - before).drop("a", "b")


def zip_words(words: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Words with the rewritten text's words by position; where that is shorter, words stay as they are."""
    out = rewritten.select("transcript_id", F.posexplode(split_words(F.col("text"))).alias("word_idx", "new_text"))
    both = words.join(out.withColumn("word_idx", F.col("word_idx").cast("long")), ["transcript_id", "word_idx"], "left")
    return both.withColumn("new_text", F.coalesce("new_text", "text")).withColumn("replaced", F.col("new_text") == REDACTED)


def merge_chunks(chunks: DataFrame, overlap: int = 70) -> DataFrame:
    """Chunks of a text as one: the first chunk that has a word decides, later ones lose their first ``overlap`` words."""
    words = chunks.select("transcript_id", "chunk", F.posexplode(split_words(F.col("text"))).alias("i", "word"))
    kept = words.where((F.col("chunk") == 0) | (F.col("i") >= overlap))
    order = F.array_sort(F.collect_list(F.struct("chunk", "i", "word")))
    return kept.groupBy("transcript_id").agg(F.array_join(F.transform(order, lambda x: x["word"]), " ").alias("text"))


def discovered_names(replacements: DataFrame) -> DataFrame:
    """Distinct replaced words, blanks and words that were redacted already left out; case counts."""
    name = F.trim("original")
    return replacements.select("transcript_id", name.alias("name")).where((F.col("name") != "") & (F.col("name") != REDACTED)).distinct()


def global_names(replacements: DataFrame) -> DataFrame:
    """Names of all transcripts: first form and speaker seen, and how often; the commonest first by ``rank``.

    Ranks are places in a total order over ranges (``ordering.positions``): no key of the names' own decides which task has them.
    """
    given = replacements.where((F.trim("original") != "") & (F.trim("original") != REDACTED))
    order = F.struct("transcript_id", "word_idx")
    out = given.groupBy(F.trim(folded(F.col("original"))).alias("norm_name")).agg(
        F.min_by(F.trim("original"), order).alias("name"), F.min_by("speaker", order).alias("source_speaker"), F.count("*").alias("occurrences")
    )
    ranked = positions(materialise(out.withColumn("low", F.lower("name")), "names"), [], [F.desc("occurrences"), "low", "norm_name"], "place")
    return ranked.select("norm_name", "name", "source_speaker", "occurrences", (F.col("place") + 1).cast("int").alias("rank"))


def prompt_list(names: DataFrame) -> DataFrame:
    """One row: the names as the lines of a prompt. A prompt is one text, so it is bounded by what a model reads, not by the tables."""
    line = F.concat(F.lit("- "), F.col("name"), F.when(F.col("occurrences") > 1, F.format_string(" (appeared %d times)", "occurrences")).otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("text"))))
    return names.agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("prompt"))


def redact_listed(words: DataFrame, names: DataFrame) -> DataFrame:
    """A rewriter without a model: words whose bare lower-case form is a listed name are redacted."""
    bare = F.btrim(folded(F.col("text")), F.lit(".,!?;:"))
    listed = names.select(F.lower("name").alias("bare"), F.lit(True).alias("listed")).distinct()
    both = words.withColumn("bare", bare).join(listed, "bare", "left")
    return both.withColumn("new_text", F.when(F.col("listed"), REDACTED).otherwise(F.col("text"))).withColumn("replaced", F.coalesce("listed", F.lit(False))).drop("bare", "listed")


def replacements(redacted: DataFrame) -> DataFrame:
    return redacted.where("replaced").select("transcript_id", "word_idx", "speaker", F.col("text").alias("original"), "start_s")


def restore_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """Words with the listed form of their name (``matched_from_list``), else themselves."""
    probe = F.btrim(folded(F.col("text")), F.lit(".,!?;:"))
    listed = names.select(F.lower("name").alias("probe"), F.col("name").alias("listed"))
    return words.withColumn("probe", probe).join(listed, "probe", "left").withColumn("matched", F.coalesce("listed", "text")).drop("probe", "listed")


def context(words: DataFrame, before: int = 5, after: int = 3) -> DataFrame:
    """Redacted words (``replaced``) with the words around them."""
    w = Window.partitionBy("transcript_id").orderBy("word_idx")
    left = F.array_join(F.collect_list("text").over(w.rowsBetween(-before, -1)), " ")
    right = F.array_join(F.collect_list("text").over(w.rowsBetween(1, after)), " ")
    out = words.withColumns({"left": left, "right": right}).where("replaced")
    target = F.concat(F.lit(">>>"), F.col("text"), F.lit("<<<"))
    return out.select("transcript_id", "word_idx", F.array_join(F.filter(F.array("left", target, "right"), lambda x: x != ""), " ").alias("context"))


def session_stats(validated: DataFrame) -> DataFrame:
    """Chunks passed and failed per transcript, with the share that passed."""
    out = validated.groupBy("transcript_id").agg(F.count("*").alias("chunks"), F.count_if("passed").alias("passed"))
    return out.withColumn("failed", F.col("chunks") - F.col("passed")).withColumn("pass_rate", F.round(F.col("passed") / F.col("chunks") * 100, 1))


def audit_summary(first: DataFrame, second: DataFrame, words: DataFrame) -> DataFrame:
    """Both passes together: replacements, distinct names and replacements per hundred words."""
    both = first.select("transcript_id", "original").unionByName(second.select("transcript_id", "original"))
    found = both.groupBy("transcript_id").agg(F.count("*").alias("replaced"), F.count_distinct(F.lower("original")).alias("names"))
    total = words.groupBy("transcript_id").agg(F.count("*").alias("n_words"))
    joined = total.join(found, "transcript_id", "left").na.fill(0, ["replaced", "names"])
    return joined.withColumn("rate", F.round(F.col("replaced") / F.col("n_words") * 100, 2))


def mute_ranges(words: DataFrame) -> DataFrame:
    """An audio filter expression per transcript that is true while a redacted word is spoken."""
    piece = F.format_string("between(t,%.3f,%.3f)", "start_s", "end_s")
    order = F.array_sort(F.collect_list(F.struct("start_s", "word_idx", piece.alias("text"))))
    return words.where("replaced").groupBy("transcript_id").agg(F.array_join(F.transform(order, lambda x: x["text"]), "+").alias("mute"))
