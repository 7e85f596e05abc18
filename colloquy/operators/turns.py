"""Classified segments to turns with attached interjections, and the merging of likely speaker errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.config import TurnConfig
from colloquy.operators.segments import joined


def assign_turns(segments: DataFrame, config: TurnConfig = TurnConfig()) -> DataFrame:
    """Adds ``is_primary`` and ``turn``.

    Primary segments begin a turn where the speaker changes or pauses longer than ``merge_gap``; interjections go with
    the last turn begun, leading ones with turn 1. Where a transcript has interjections only, each is a turn. One window
    order serves all of it, so segments are sorted once and joined never.
    """
    t = Window.partitionBy("transcript_id")
    w = t.orderBy("seg")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    all_short = F.min(F.col("is_interjection").cast("int")).over(t) == 1
    out = segments.withColumn("is_primary", ~F.col("is_interjection") | all_short).withColumn("alone", all_short)
    last = lambda c: F.last(F.when(F.col("is_primary"), F.col(c)), ignorenulls=True).over(past)
    out = out.withColumns({"last_speaker": last("speaker"), "last_end": last("end_s")})
    begins = F.col("alone") | F.col("last_speaker").isNull() | (F.col("last_speaker") != F.col("speaker")) | (F.col("start_s") - F.col("last_end") > config.merge_gap)
    out = out.withColumn("begins", F.when(F.col("is_primary") & begins, 1).otherwise(0))
    turn = F.greatest(F.lit(1), F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("turn", turn.cast("long")).drop("alone", "last_speaker", "last_end", "begins")


def flow_continuity(duration: Column, spoken: Column, n: Column, n_disruptive: Column) -> Column:
    primary = F.greatest(F.lit(0.0), (duration - spoken) / duration)
    value = primary * (1 - F.least(n * 0.1, F.lit(0.5))) - F.least(n_disruptive * 0.1, F.lit(0.3))
    return F.when((n == 0) | (duration == 0), 1.0).otherwise(F.round(F.greatest(F.lit(0.0), value), 3))


def _disruptive(level: Column) -> Column:
    return level.isin("medium", "high")


def turn_metrics(turns: DataFrame) -> DataFrame:
    """Adds duration, rate, flow and type to turns with ``n_words`` and ``interjections``."""
    inner = F.col("interjections")
    rounded = turns.withColumn("duration_s", F.round(F.col("end_s") - F.col("start_s"), 3))
    n = F.size(inner)
    spoken = F.aggregate(inner, F.lit(0.0), lambda s, x: s + (x["end_s"] - x["start_s"]))
    bad = F.size(F.filter(inner, lambda x: _disruptive(x["level"])))
    duration = F.col("duration_s")
    return rounded.withColumns(
        {
            "n_interjections": n.cast("long"),
            "rate_wpm": F.when(duration > 0, F.round(F.col("n_words") / duration * 60, 1)).otherwise(0.0),
            "flow": flow_continuity(duration, spoken, n, bad),
            "turn_type": F.when(n == 0, "monologue").when(bad > 0, "interrupted").otherwise("acknowledged"),
        }
    )


def _gathered(assigned: DataFrame, *more: Column) -> DataFrame:
    primary = F.col("is_primary")
    item = F.struct("start_s", "seg", "end_s", "speaker", "text", "n_words", "itype", "confidence", "level", "error")
    of = lambda c, how: how(F.when(primary, F.col(c)), F.when(primary, F.col("seg")))
    return assigned.groupBy("transcript_id", "turn").agg(
        of("speaker", F.min_by).alias("speaker"),
        of("start_s", F.min_by).alias("start_s"),
        of("end_s", F.max_by).alias("end_s"),
        joined(F.collect_list(F.when(primary, F.struct("seg", "text")))).alias("text"),
        F.sum(F.when(primary, F.col("n_words"))).alias("n_words"),
        F.array_sort(F.collect_list(F.when(~primary, item))).alias("interjections"),
        *more,
    )


def build_turns(assigned: DataFrame) -> DataFrame:
    """One row per turn, with its interjections as an array of structs in order of start."""
    return turn_metrics(_gathered(assigned))


def refine_turns(assigned: DataFrame) -> DataFrame:
    """Turns whose likely speaker errors have become words of the turn; ``assigned`` segments hold their ``words``.

    An error's only word goes between the turn's words by start time, behind equal ones; text, times and metrics are made
    anew from the remaining interjections. Turns without errors keep theirs. Words travel inside their segments, so turns are
    gathered once and nothing is joined.
    """
    own = F.col("is_primary") | F.col("error")
    word = F.transform("words", lambda w: F.struct(w["start_s"].alias("start_s"), (~F.col("is_primary")).alias("late"), w["ord"].alias("ord"), w["text"].alias("text")))
    rows = _gathered(
        assigned,
        joined(F.flatten(F.collect_list(F.when(own, word)))).alias("all_text"),
        F.min(F.when(own, F.array_min(F.col("words.start_s")))).alias("least_start"),
        F.max(F.when(own, F.array_max(F.col("words.end_s")))).alias("greatest_end"),
        F.sum(F.when(own, F.col("n_words"))).alias("all_words"),
        F.max(F.col("error") & ~F.col("is_primary")).alias("has_error"),
    )
    pick = lambda new, old: F.when(F.col("has_error"), new).otherwise(F.col(old))
    refined = rows.select(
        "transcript_id", "turn", "speaker",
        pick(F.least("start_s", "least_start"), "start_s").alias("start_s"),
        pick(F.greatest("end_s", "greatest_end"), "end_s").alias("end_s"),
        pick(F.col("all_text"), "text").alias("text"),
        pick(F.col("all_words"), "n_words").alias("n_words"),
        F.filter("interjections", lambda x: ~x["error"]).alias("interjections"),
    )
    return turn_metrics(refined)


def build_audit(assigned: DataFrame) -> DataFrame:
    """What each step of turn building made, per transcript: segments, interjections by kind, likely errors, primaries and turns."""
    short = F.col("is_interjection")
    return assigned.groupBy("transcript_id").agg(
        F.count("*").alias("segments"), F.count_if(short).alias("interjections"), F.count_if(short & (F.col("itype") == "unclear")).alias("unclear"),
        F.count_if(F.col("error")).alias("likely_errors"), F.count_if(F.col("is_primary")).alias("primary_segments"), F.max("turn").alias("turns"),
    )


def merge_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Turns and interjections that merging took away, per transcript."""
    count = lambda df, tag: df.groupBy("transcript_id").agg(F.count("*").alias(f"turns_{tag}"), F.sum("n_interjections").alias(f"interjections_{tag}"))
    both = count(before, "before").join(count(after, "after"), "transcript_id", "left")
    less = lambda c: F.col(f"{c}_before") - F.coalesce(f"{c}_after", F.lit(0))
    return both.select("transcript_id", less("turns").alias("turns_merged"), less("interjections").alias("interjections_merged"), (less("turns") + less("interjections")).alias("merged"))
