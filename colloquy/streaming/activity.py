"""Words that arrive as a stream: who speaks in which stretch, closed by a pause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speaking_sessions(words: DataFrame, pause: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """``transcript_id, speaker, start_ts, end_ts, n_words`` of runs of words without a ``pause``.

    ``words``: ``transcript_id, speaker, ts`` with the event time of each word, streaming or not. State is one open session
    per transcript and speaker; words later than ``late`` behind the newest are left out of a stream. A null speaker is
    "Unknown", rows without a time belong to no session.
    """
    who = F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit("Unknown"))
    timed = words.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    out = timed.groupBy("transcript_id", who.alias("speaker"), F.session_window("ts", pause).alias("session")).agg(F.count("*").alias("n_words"))
    return out.select("transcript_id", "speaker", F.col("session.start").alias("start_ts"), F.col("session.end").alias("end_ts"), "n_words")
