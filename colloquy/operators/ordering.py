"""Positions in a total order, without a window over a whole group: the rows are dealt out by ranges of the order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.work import materialise

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number in the partition below


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], pos: str = "pos", total: str | None = None) -> DataFrame:
    """``df`` with the 0-based place of each row in its group, and the rows of the group as ``total``.

    Rows are range partitioned by group and order and sorted inside partitions, so a group of any size is spread over as many
    tasks as it fills. Each (partition, group) is counted; a running sum over those counts, one row for each, shifts the row
    numbers of the partitions. An empty ``group`` ranks all rows. Nulls are groups of their own and come first; rows
    equal in group and order stand together in some order. The frame is read twice (the ranges are sampled), so hand
    in a written table.
    """
    ranged = materialise(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", _ROW_BITS)
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    counts = ranged.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    in_group = Window.partitionBy(*(f"_g{i}" for i in range(len(group))) if group else (F.lit(0),))
    before = F.coalesce(F.sum("_n").over(in_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(f"_g{i}" for i in range(len(group))), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(in_group).alias("_total"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)), part == F.col("_part"))
    out = ranged.join(starts, same).withColumn(pos, F.col("_at") + F.col("_shift"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, pos, *([total] if total else []))
