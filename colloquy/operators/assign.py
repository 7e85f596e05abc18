"""Speakers for words by overlap with diarization segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_speakers(words: DataFrame, diar: DataFrame, bucket_s: float | None = 60.0) -> DataFrame:
    """Each word gets the speaker of the one segment that overlaps it most; the greatest name wins ties; else "Unknown".

    ``diar``: ``transcript_id, start_s, end_s, speaker``. The range condition alone would compare every word with every segment
    of its transcript; with ``bucket_s``, both sides are keyed by the stretches of that many seconds that they touch, so an
    equi-join meets only neighbours, and a very long transcript is many keys. ``None`` joins on the transcript alone.
    """
    seg = diar.select("transcript_id", F.col("start_s").alias("d_start"), F.col("end_s").alias("d_end"), F.col("speaker").alias("d_speaker"))
    keys = ["transcript_id"]
    if bucket_s:
        touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_s), F.floor(F.greatest(a, b) / bucket_s)))
        left = words.withColumn("_bucket", touched("start_s", "end_s"))
        seg = seg.withColumn("_bucket", touched("d_start", "d_end"))
        keys.append("_bucket")
    else:
        left = words
    overlap = F.least("end_s", "d_end") - F.greatest("start_s", "d_start")
    near = left.join(seg, keys, "left").withColumn("overlap", F.when(overlap > 0, overlap))
    others = [c for c in words.columns if c not in ("transcript_id", "word_idx", "speaker")]  # the same in all rows of a word
    best = near.groupBy("transcript_id", "word_idx").agg(*(F.any_value(c).alias(c) for c in others), F.max(F.when(F.col("overlap") > 0, F.struct("overlap", "d_speaker"))).alias("best"))
    return best.withColumn("speaker", F.coalesce("best.d_speaker", F.lit("Unknown"))).select(*words.columns)
