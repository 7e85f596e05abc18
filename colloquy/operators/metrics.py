"""Aggregates over words and turns of each transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.segments import as_given, joined, order_words


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves up even where the nearest double is a little less than the half."""
    return F.round(x + 1e-9, digits)


def transcript_metadata(words: DataFrame) -> DataFrame:
    named = F.nullif(F.col("speaker"), F.lit(""))
    out = order_words(words).groupBy("transcript_id").agg(
        F.count("*").alias("total_words"),
        F.array_join(F.array_sort(F.collect_set(named)), ",").alias("speakers"),
        F.count_distinct(named).alias("speaker_count"),
        F.min_by("start_s", "ord").alias("first_start_s"),
        F.max_by("end_s", "ord").alias("last_end_s"),
    )
    return out.withColumn("duration_s", F.round(F.col("last_end_s") - F.col("first_start_s"), 6))


def conversation_metrics(turns: DataFrame) -> DataFrame:
    """Duration runs from the first turn's start to the last turn's end, in order of turns."""
    t = turns.groupBy("transcript_id").agg(
        F.count("*").alias("total_turns"),
        F.sum("n_interjections").alias("total_interjections"),
        (F.max_by("end_s", "turn") - F.min_by("start_s", "turn")).alias("span"),
        F.sum("n_words").alias("total_words"),
        half_up(F.sum(F.col("duration_s").cast("decimal(18,3)")).cast("double") / F.count("*"), 2).alias("avg_turn_duration"),
        half_up(F.sum("n_words") / F.count("*"), 1).alias("avg_turn_words"),
        half_up(F.sum(F.col("rate_wpm").cast("decimal(18,1)")).cast("double") / F.count("*"), 1).alias("avg_speaking_rate"),
        half_up(F.sum(F.col("flow").cast("decimal(18,3)")).cast("double") / F.count("*"), 3).alias("avg_flow"),
    )
    rate = F.when(F.col("span") > 0, half_up(F.col("total_interjections") / F.col("span") * 60, 2)).otherwise(0.0)
    return t.withColumn("total_duration", half_up(F.col("span"), 2)).withColumn("interjection_rate", rate).drop("span")


def turn_type_distribution(turns: DataFrame) -> DataFrame:
    return turns.groupBy("transcript_id").agg(*(F.count_if(F.col("turn_type") == k).alias(k) for k in ("monologue", "acknowledged", "interrupted")))


def speaker_statistics(turns: DataFrame) -> DataFrame:
    """Per speaker: own turns, and interjections made in turns of others. Turns are read once: each gives a row per speaker in it."""
    row = lambda speaker, own: F.struct(speaker.alias("speaker"), F.lit(own).alias("own"))
    part = F.explode(F.concat(F.array(row(F.col("speaker"), True)), F.transform("interjections", lambda x: row(x["speaker"], False))))
    rows = turns.select("transcript_id", "n_words", "duration_s", "rate_wpm", "flow", part.alias("p"))
    mine = F.col("p.own")
    exact = lambda c, d: F.sum(F.when(mine, F.col(c).cast(f"decimal(18,{d})"))).cast("double")
    both = rows.groupBy("transcript_id", F.col("p.speaker").alias("speaker")).agg(
        F.count_if(mine).alias("total_turns"), F.coalesce(F.sum(F.when(mine, F.col("n_words"))), F.lit(0)).alias("total_words"), exact("duration_s", 3).alias("duration"),
        exact("rate_wpm", 1).alias("rates"), exact("flow", 3).alias("flows"), F.count_if(~mine).alias("total_interjections"),
    )
    mean = lambda c, d: F.when(F.col("total_turns") > 0, half_up(F.col(c) / F.col("total_turns"), d)).otherwise(0.0)
    return both.select(
        "transcript_id", "speaker", "total_turns", "total_words",
        F.coalesce(half_up(F.col("duration"), 2), F.lit(0.0)).alias("total_duration"), "total_interjections",
        mean("duration", 2).alias("avg_turn_duration"), mean("rates", 1).alias("avg_speaking_rate"), mean("flows", 3).alias("avg_flow"),
    )


def speaker_word_counts(words: DataFrame) -> DataFrame:
    who = F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit("(no speaker)"))
    return words.groupBy("transcript_id", who.alias("speaker")).agg(F.count("*").alias("n_words"))


def speaker_samples(words: DataFrame, size: int = 30) -> DataFrame:
    """Up to three stretches of each speaker's words: the first, the middle and the last."""
    own = Window.partitionBy("transcript_id", "speaker")
    numbered = words.where("speaker IS NOT NULL AND speaker <> ''").withColumns({"i": F.row_number().over(own.orderBy("word_idx")) - 1, "n": F.count("*").over(own)})
    half = F.floor(F.col("n") / 2)
    starts = F.array(F.lit(0).cast("long"), F.when(F.col("n") > 2 * size, half), F.when(F.col("n") > 3 * size, F.col("n") - size))
    placed = numbered.select("*", F.posexplode(starts).alias("sample", "at")).where(F.col("at").isNotNull() & (F.col("i") >= F.col("at")) & (F.col("i") < F.col("at") + size))
    return placed.groupBy("transcript_id", "speaker", "sample").agg(joined(F.collect_list(F.struct("i", "text"))).alias("text"))


def first_words(words: DataFrame, size: int = 20) -> DataFrame:
    """Each speaker's first words, with dots where there may be more."""
    own = Window.partitionBy("transcript_id", "speaker").orderBy("word_idx")
    few = words.where("speaker IS NOT NULL").withColumn("i", F.row_number().over(own)).where(F.col("i") <= size)
    text = joined(F.collect_list(F.struct("i", "text")))
    return few.groupBy("transcript_id", "speaker").agg(F.concat(text, F.when(F.count("*") >= size, "...").otherwise("")).alias("sample"))


def checkpoint_quality(words: DataFrame, gap: float = 1.0) -> DataFrame:
    """Overlaps, gaps and faults of the words as given."""
    before = words.withColumn("prev_end", F.lag("end_s", 1, 0.0).over(as_given()))
    overlap = F.col("start_s") < F.col("prev_end")
    missing = F.col("speaker").isNull() | (F.col("speaker") == "")
    return before.groupBy("transcript_id").agg(
        F.count("*").alias("n_words"),
        F.count_if(overlap).alias("n_overlaps"),
        F.count_if(~overlap & (F.col("start_s") > F.col("prev_end") + gap)).alias("n_gaps"),
        F.count_if(F.col("start_s") > F.col("end_s")).alias("n_reversed"),
        F.count_if(missing).alias("n_without_speaker"),
        F.count_if(F.lower("speaker") == "unknown").alias("n_unknown_speaker"),
    )
