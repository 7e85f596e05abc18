"""Subtitle cues of few words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.config import REDACTED
from colloquy.operators.segments import as_given, joined


def shown(text: Column) -> Column:
    """A word as it is displayed: a blank line for a redacted one."""
    return F.when(text == REDACTED, "______").otherwise(text)


def subtitle_cues(words: DataFrame, size: int = 3) -> DataFrame:
    """Cues of at most ``size`` words of one speaker (no speaker is one too); redacted words show as a blank line."""
    changes = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(as_given())) | F.lag("word_idx").over(as_given()).isNull()
    runs = words.withColumn("begins", changes.cast("int")).withColumn("run", F.sum("begins").over(as_given()))
    place = F.row_number().over(Window.partitionBy("transcript_id", "run").orderBy("word_idx")) - 1
    return runs.withColumn("k", F.floor(place / size)).groupBy("transcript_id", "run", "k").agg(
        F.first("speaker").alias("speaker"), F.min_by("start_s", "word_idx").alias("start_s"), F.max_by("end_s", "word_idx").alias("end_s"),
        joined(F.collect_list(F.struct("word_idx", shown(F.col("text")).alias("text")))).alias("text"), F.min("word_idx").alias("first_word"),
    )
