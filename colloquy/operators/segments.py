"""Words to speaker segments: ordering, jumps, islands of one speaker and the gaps between them.

``words``: ``transcript_id, word_idx, text, start_s, end_s, speaker``. Everything is partitioned by transcript; ``word_idx``
keeps the given order, which decides between words of equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_time() -> WindowSpec:
    return Window.partitionBy("transcript_id").orderBy("start_s", "end_s", "word_idx")


def as_given() -> WindowSpec:
    return Window.partitionBy("transcript_id").orderBy("word_idx")


def speaker_or_unknown(name: str = "speaker") -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("Unknown"))


def joined(items: Column, sep: str = " ") -> Column:
    """Texts of ``(order, text)`` structs in order, as one string."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), sep)


def coerce_words(words: DataFrame) -> DataFrame:
    """Missing text is empty, missing times are 0, a missing speaker stays null."""
    zero = F.lit(0.0)
    return words.withColumns({"text": F.coalesce("text", F.lit("")), "start_s": F.coalesce("start_s", zero), "end_s": F.coalesce("end_s", zero)})


def order_words(words: DataFrame) -> DataFrame:
    """Adds ``ord``, a word's place in time within its transcript (from 0)."""
    return words.withColumn("ord", F.row_number().over(in_time()).cast("long") - 1)


def time_jumps(words: DataFrame, significant: float = 0.5) -> DataFrame:
    """Places where the next word, as given, starts before this one."""
    after = words.select("transcript_id", "word_idx", "start_s", F.lead("start_s").over(as_given()).alias("next_start_s"))
    jump = F.round(F.col("start_s") - F.col("next_start_s"), 6)
    return after.where("next_start_s < start_s").withColumn("jump_s", jump).withColumn("significant", F.col("jump_s") > significant)


def speaker_segments(words: DataFrame, keep_words: bool = False) -> DataFrame:
    """Islands of consecutive words of one speaker. ``end_s`` is the last word's, which need not be the greatest.

    ``keep_words`` adds the array ``words`` of ``start_s, ord, end_s, text``, so that later steps need no join back.
    """
    who = order_words(words).withColumn("who", speaker_or_unknown())
    in_order = Window.partitionBy("transcript_id").orderBy("ord")
    before = F.lag("who").over(in_order)
    marked = who.withColumn("begins", F.when(before.isNull() | (before != F.col("who")), 1).otherwise(0))
    return gathered(marked.withColumn("seg", F.sum("begins").over(in_order)), keep_words)


def gathered(numbered: DataFrame, keep_words: bool = False) -> DataFrame:
    """Words with ``who``, ``ord`` and the number ``seg`` of their segment, as one row a segment."""
    held = [F.collect_list(F.struct("start_s", "ord", "end_s", "text")).alias("words")] if keep_words else []
    return (
        numbered.groupBy("transcript_id", "seg")
        .agg(
            F.first("who").alias("speaker"),
            F.min_by("start_s", "ord").alias("start_s"),
            F.max_by("end_s", "ord").alias("end_s"),
            joined(F.collect_list(F.struct("ord", "text"))).alias("text"),
            F.count("*").alias("n_words"),
            *held,
        )
        .withColumn("duration_s", F.col("end_s") - F.col("start_s"))
    )


def with_gaps(segments: DataFrame, *within: str) -> DataFrame:
    """Adds the gaps to both neighbours; negative where they overlap, null at the ends (of transcripts, or ``within`` parts of them)."""
    w = Window.partitionBy("transcript_id", *within).orderBy("seg")
    return segments.withColumns({"gap_before": F.col("start_s") - F.lag("end_s").over(w), "gap_after": F.lead("start_s").over(w) - F.col("end_s")})


def paragraphs(turns: DataFrame) -> DataFrame:
    """Consecutive turns of one speaker as one paragraph: ``transcript_id, paragraph, speaker, text``."""
    w = Window.partitionBy("transcript_id").orderBy("turn")
    before = F.lag("speaker").over(w)
    begins = F.when(before.isNull() | (before != F.col("speaker")), 1).otherwise(0)
    marked = turns.withColumn("begins", begins).withColumn("paragraph", F.sum("begins").over(w))
    return marked.groupBy("transcript_id", "paragraph").agg(F.first("speaker").alias("speaker"), joined(F.collect_list(F.struct("turn", "text"))).alias("text"))


def restrict_range(words: DataFrame, from_s: float, to_s: float) -> DataFrame:
    """Words that lie wholly between two times."""
    if to_s <= from_s:
        raise ValueError(f"the range ends at {to_s}, before it starts at {from_s}")
    return words.where((F.col("start_s") >= from_s) & (F.col("end_s") <= to_s))


def previews(turns: DataFrame, rows: int = 10, chars: int = 50) -> DataFrame:
    """The beginnings of each transcript's first turns."""
    place = F.row_number().over(Window.partitionBy("transcript_id").orderBy("turn"))
    short = F.when(F.length("text") > chars, F.concat(F.left("text", F.lit(chars)), F.lit("..."))).otherwise(F.col("text"))
    return turns.withColumn("place", place).where(F.col("place") <= rows).select("transcript_id", "turn", "speaker", short.alias("preview"))


def chunk_audio(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments with the audio of their chunk (by ``transcript_id, chunk``); without one, null."""
    return segments.join(chunks.select("transcript_id", "chunk", "audio"), ["transcript_id", "chunk"], "left")


def mono(channels: Column) -> Column:
    """The mean over channels (an array of equally long arrays) of each sample."""
    first = F.transform(channels[0], lambda x: x.cast("double"))
    total = F.aggregate(F.slice(channels, F.lit(2), F.greatest(F.size(channels) - 1, F.lit(0))), first, lambda acc, c: F.zip_with(acc, c, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(channels))
