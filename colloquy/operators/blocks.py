"""Segments and turns of transcripts too long for one task: the same rows as ``segments`` and ``turns`` give, block by block.

Words fall into blocks of time, segments into blocks of their numbers; windows run inside a block, and what they need from outside comes from
border tables with one row a block: how many words, segments and turns began before, and who spoke last. What looks one
segment to each side has the neighbouring block's edge in its own block. A transcript is as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.config import TurnConfig
from colloquy.operators import classify, segments
from colloquy.work import materialise

_BLOCK = ("transcript_id", "block")
_EARLIER = (Window.unboundedPreceding, -1)


def _over_blocks() -> Window:
    return Window.partitionBy("transcript_id").orderBy("block")


def _before(n: str) -> Column:
    """The sum over all earlier blocks of a border table's column."""
    return F.coalesce(F.sum(n).over(_over_blocks().rowsBetween(*_EARLIER)), F.lit(0))


def speaker_segments(words: DataFrame, seconds: float = 600.0, keep_words: bool = False) -> DataFrame:
    """As ``segments.speaker_segments``, in blocks of ``seconds``: an island goes on over a border if its speaker does."""
    placed = words.withColumn("block", F.floor(F.col("start_s") / seconds)).withColumn("who", segments.speaker_or_unknown())
    order = F.struct("start_s", "end_s", "word_idx")
    ends = materialise(placed.groupBy(*_BLOCK).agg(F.count("*").alias("n"), F.max_by("who", order).alias("last_who")), "ends")
    entries = ends.select(*_BLOCK, _before("n").alias("ord_before"), F.lag("last_who").over(_over_blocks()).alias("who_before"))
    inside = Window.partitionBy(*_BLOCK).orderBy("start_s", "end_s", "word_idx")
    place = F.row_number().over(inside)
    rows = placed.withColumns({"place": place, "previous": F.lag("who").over(inside)}).join(entries, list(_BLOCK))
    previous = F.when(F.col("place") == 1, F.col("who_before")).otherwise(F.col("previous"))
    begins = F.when(previous.isNull() | (previous != F.col("who")), 1).otherwise(0)
    rows = materialise(rows.withColumns({"begins": begins, "ord": F.col("place") - 1 + F.col("ord_before")}).drop("place", "previous", "ord_before", "who_before"), "marked")
    offsets = rows.groupBy(*_BLOCK).agg(F.sum("begins").alias("n")).select(*_BLOCK, _before("n").alias("seg_before"))
    so_far = F.sum("begins").over(Window.partitionBy(*_BLOCK).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("so_far", so_far).join(offsets, list(_BLOCK)).withColumn("seg", F.col("seg_before") + F.col("so_far"))
    return segments.gathered(numbered, keep_words)


def classified_segments(rows: DataFrame, config: TurnConfig = TurnConfig(), size: int = 4096) -> DataFrame:
    """Segments with gaps and classes, and their ``block``: ``size`` segments, with one of each neighbour beside them while windows run."""
    own = F.expr(f"seg div {size}")
    near = F.array_distinct(F.array(F.expr(f"(seg - 1) div {size}"), own, F.expr(f"(seg + 1) div {size}")))
    spread = rows.withColumn("block", F.explode(near))
    known = classify.classify_segments(segments.with_gaps(spread, "block"), config, "block")
    return known.where(F.col("block") == own)


def assign_turns(classified: DataFrame, config: TurnConfig = TurnConfig()) -> DataFrame:
    """As ``turns.assign_turns`` for ``classified_segments``: blocks begin with the last primary segment and the turns before them."""
    rows = materialise(classified, "classified")
    spoken = ~F.col("is_interjection")
    last = F.max_by(F.when(spoken, F.struct("speaker", "end_s")), F.when(spoken, F.col("seg"))).alias("last")
    borders = materialise(rows.groupBy(*_BLOCK).agg(last, F.min(F.col("is_interjection").cast("int")).alias("all_short")), "borders")
    entry = F.last("last", ignorenulls=True).over(_over_blocks().rowsBetween(*_EARLIER))
    alone = F.min("all_short").over(Window.partitionBy("transcript_id")) == 1
    entries = borders.select(*_BLOCK, entry.alias("entry"), alone.alias("alone"))
    inside = Window.partitionBy(*_BLOCK).orderBy("seg")
    held = F.last(F.when(spoken, F.struct("speaker", "end_s")), ignorenulls=True).over(inside.rowsBetween(*_EARLIER))
    out = rows.withColumn("held", held).join(entries, list(_BLOCK)).withColumn("before", F.coalesce("held", "entry"))
    out = out.withColumn("is_primary", spoken | F.col("alone"))
    new = F.col("alone") | F.col("before").isNull() | (F.col("before.speaker") != F.col("speaker")) | (F.col("start_s") - F.col("before.end_s") > config.merge_gap)
    out = materialise(out.withColumn("begins", F.when(F.col("is_primary") & new, 1).otherwise(0)).drop("held", "entry", "alone", "before"), "begun")
    offsets = out.groupBy(*_BLOCK).agg(F.sum("begins").alias("n")).select(*_BLOCK, _before("n").alias("turns_before"))
    so_far = F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    turn = F.greatest(F.lit(1), F.col("turns_before") + F.col("so_far")).cast("long")
    return out.withColumn("so_far", so_far).join(offsets, list(_BLOCK)).withColumn("turn", turn).drop("begins", "so_far", "turns_before", "block")


def assigned_segments(words: DataFrame, config: TurnConfig = TurnConfig(), seconds: float = 600.0, size: int = 4096, keep_words: bool = False) -> DataFrame:
    """Words to segments with their turns, which ``turns.build_turns`` and ``turns.refine_turns`` take."""
    found = materialise(speaker_segments(words, seconds, keep_words), "segments")
    return assign_turns(classified_segments(found, config, size), config)
