"""Preparation of turns for a language model: cleaned texts, labelled segments of bounded length, and statistics.

``turns``: ``transcript_id, turn, speaker, text``. All is per row but the statistics, which combine before they shuffle.
Edge cases: a null text is empty and gives no segment; a null or empty speaker is ``Unknown`` where labels are standardised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators.align import pack_sentences

MODES = ("basic", "advanced")


def prepare_turns(turns: DataFrame, mode: str = "basic", labels: bool = True, whitespace: bool = True, characters: bool = True) -> DataFrame:
    """Turns with standardised ``speaker`` and, in ``advanced`` mode, plain white space and characters in ``text``."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {MODES}")
    text: Column = F.coalesce("text", F.lit(""))
    if mode == "advanced":
        text = tx.normalize_whitespace(text) if whitespace else text
        text = tx.special_characters(text) if characters else text
    speaker = tx.speaker_label(F.col("speaker")) if labels else F.col("speaker")
    return turns.withColumns({"text": text, "speaker": speaker})


def split_lines(lines: DataFrame, max_words: int = 500) -> DataFrame:
    """``segment, part`` of each row's ``line``: what stands before the first ``": "`` is a label that every part gets."""
    cut = F.instr("line", ": ")
    label = F.when(cut > 0, F.substring("line", F.lit(1), cut - 1))
    body = F.when(cut > 0, F.substring("line", cut + 2, F.length("line"))).otherwise(F.col("line"))
    pieces = pack_sentences(lines.withColumn("sentences", tx.sentences(body)).withColumn("label", label), max_words)
    rows = pieces.select(*lines.columns, "label", F.posexplode("pieces").alias("part", "piece"))
    return rows.withColumn("segment", F.concat_ws(": ", "label", "piece")).drop("label", "piece")


def turn_segments(turns: DataFrame, max_words: int = 500) -> DataFrame:
    """``transcript_id, turn, part, segment``: ``speaker: text`` lines in parts of whole sentences."""
    lines = turns.select("transcript_id", "turn", F.concat_ws(": ", F.coalesce("speaker", F.lit("")), "text").alias("line"))
    return split_lines(lines, max_words).select("transcript_id", "turn", "part", "segment")


def preparation_stats(given: DataFrame, prepared: DataFrame, segments: DataFrame) -> DataFrame:
    """Per transcript: turns given and prepared, words, segments, and how many more segments than turns there are."""
    n_words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    before = given.groupBy("transcript_id").agg(F.count("*").alias("original_turns"))
    after = prepared.groupBy("transcript_id").agg(F.count("*").alias("processed_turns"), F.sum(n_words).alias("words_processed"))
    made = segments.groupBy("transcript_id").agg(F.count("*").alias("segments_created"))
    joined = before.join(after, "transcript_id").join(made, "transcript_id", "left").na.fill(0, ["segments_created"])
    return joined.withColumn("turns_split", F.col("segments_created") - F.col("original_turns"))
