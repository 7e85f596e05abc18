"""Word checkpoints in JSON: one document per transcript, with metadata and an array of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "transcript_id INT, metadata STRUCT<total_words: BIGINT, format_version: STRING, mode: STRING>, "
    "words ARRAY<STRUCT<text: STRING, start: DOUBLE, end: DOUBLE, speaker: STRING>>"
)


def read_checkpoints(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``transcript_id, word_idx, text, start_s, end_s, speaker, mode`` of all checkpoints under ``path``.

    A checkpoint without words, or a word without text, start or end, is fatal (``strict``) or left out.
    """
    docs = spark.read.schema(SCHEMA).json(path, multiLine=True)
    words = F.col("words")
    if strict:
        empty = F.raise_error(F.lit("a checkpoint has no words")).cast(docs.schema["words"].dataType)
        words = F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, words).otherwise(empty)
    rows = docs.select("transcript_id", F.col("metadata.mode").alias("mode"), F.posexplode(words).alias("word_idx", "w"))
    whole = F.col("w.text").isNotNull() & F.col("w.start").isNotNull() & F.col("w.end").isNotNull()
    fault = F.raise_error(F.lit("a word lacks text, start or end")).cast("boolean")
    rows = rows.where(F.when(whole, True).otherwise(fault) if strict else whole)
    return rows.select("transcript_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("w.text").alias("text"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), F.col("w.speaker").alias("speaker"), "mode")


def scan_checkpoints(docs: DataFrame) -> DataFrame:
    """Every word of ``path, value`` (one JSON document a row): ``path, pos, text, start_s, end_s, speaker, problem``.

    ``problem`` is null for a whole word, else ``text``, ``start`` or ``end``: the first field that is missing. A document that is no
    JSON (``json``) or has no words (``words``) is one row without a word.
    """
    parsed = docs.select("path", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("d"), F.expr("try_parse_json(value) IS NULL").alias("broken"))
    rows = parsed.select("path", "broken", F.posexplode_outer("d.words").alias("pos", "w"))
    problem = F.when(F.col("broken"), "json").when(F.col("w").isNull(), "words")
    for field in ("text", "start", "end"):
        problem = problem.when(F.col(f"w.{field}").isNull(), field)
    return rows.select("path", F.col("pos").cast("long").alias("pos"), F.col("w.text").alias("text"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), F.col("w.speaker").alias("speaker"), problem.alias("problem"))


def checkpoint_json(words: DataFrame, mode: str | None = None) -> DataFrame:
    """``transcript_id, json``: checkpoints that ``read_checkpoints`` takes."""
    word = F.struct("word_idx", F.struct(F.col("text"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("speaker")).alias("w"))
    grouped = words.groupBy("transcript_id").agg(F.array_sort(F.collect_list(word)).alias("items"))
    meta = F.struct(F.size("items").cast("long").alias("total_words"), F.lit("1.0").alias("format_version"), F.lit(mode).cast("string").alias("mode"))
    body = F.struct("transcript_id", meta.alias("metadata"), F.transform("items", lambda x: x["w"]).alias("words"))
    return grouped.select("transcript_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
