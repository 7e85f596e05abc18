"""Rules that tell interjections from turns, by length, wording and timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.config import TurnConfig


def interjection_type(text: Column, patterns: dict[str, list[str]]) -> Column:
    """``(type, boost)`` by the first pattern that is the text (0.3), its beginning or end (0.2) or within it (0.1)."""
    low = F.trim(F.lower(text))
    out = None
    for category, words in patterns.items():
        for p in words:
            boost = F.when(low == p, 0.3).when(low.startswith(p + " ") | low.endswith(" " + p), 0.2).otherwise(0.1)
            found = F.struct(F.lit(category).alias("type"), boost.alias("boost"))
            out = F.when(low.contains(p), found) if out is None else out.when(low.contains(p), found)
    unclear = F.struct(F.lit("unclear").alias("type"), F.lit(0.0).alias("boost"))
    return unclear if out is None else out.otherwise(unclear)


def interrupt_level(before: str = "gap_before", after: str = "gap_after") -> Column:
    b, a = F.coalesce(F.col(before) < 0, F.lit(False)), F.coalesce(F.col(after) < 0, F.lit(False))
    overlap = F.when(b, -F.col(before)).otherwise(-F.col(after))
    one = F.when(overlap > 0.5, "high").when(overlap > 0.2, "medium").otherwise("low")
    none = F.when(F.least(before, after) < 0.3, "low").otherwise("none")
    return F.when(b & a, "high").when(b | a, one).otherwise(none)


def classify_segments(segments: DataFrame, config: TurnConfig = TurnConfig(), *within: str) -> DataFrame:
    """Adds ``is_interjection, confidence, itype, level, error`` to segments with gaps.

    A short segment is an interjection whatever it says. ``error``: one unclear word between two segments of one other
    speaker, most likely the speaker recognition's fault.
    """
    w = Window.partitionBy("transcript_id", *within).orderBy("seg")
    short = (F.col("duration_s") <= config.max_seconds) & (F.col("n_words") <= config.max_words)
    kind = interjection_type(F.col("text"), config.patterns)
    base = ((1 - F.col("duration_s") / config.max_seconds) + (1 - F.col("n_words") / F.lit(float(config.max_words)))) / 2
    prev, nxt = F.lag("speaker").over(w), F.lead("speaker").over(w)
    lonely = (F.col("n_words") == 1) & (F.col("itype") == "unclear") & (prev == nxt) & (prev != F.col("speaker"))
    return (
        segments.withColumn("is_interjection", short)
        .withColumn("kind", F.when(short, kind))
        .withColumns(
            {
                "itype": F.when(short, F.col("kind.type")).otherwise("none"),
                "confidence": F.when(short, F.least(F.lit(1.0), base + F.col("kind.boost"))).otherwise(0.0),
                "level": F.when(short, interrupt_level()).otherwise("none"),
            }
        )
        .withColumn("error", F.coalesce(short & lonely, F.lit(False)))
        .drop("kind")
    )
