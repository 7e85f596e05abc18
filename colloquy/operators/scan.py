"""Folds whose state passes from row to row, over groups of any length: blocks run in parallel and agree at their borders.

Rows of a group are numbered by ranges and cut into blocks of a fixed size. A block is preceded by some rows of the one before, its
run-up: folding those from no state gives the state that it most likely starts with. All blocks run at once; then
the state each one started with is held against the one its predecessor ended with, and only blocks where they differ run again from the right
state, until all agree. The result is that of the plain fold, whatever the run-up; a longer one only saves repeats. No task sees more
than a block, and the border table has one row a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from colloquy.operators.ordering import positions
from colloquy.work import materialise

#: Rows (as dicts, in order) and the state before them to their outputs (one a row) and the state behind them.
Fold = Callable[[list[dict], object], tuple[list, object]]


def blocks_of(rows: DataFrame, key: str, order: Sequence[str], size: int, run_up: int, written: bool = False) -> DataFrame:
    """``key, block, lead, items``: each block's rows in order behind ``lead`` rows of the block before; ``written`` rows are read as they are."""
    placed = positions(rows if written else materialise(rows, "scanned"), [key], order, "_pos")
    block = F.expr(f"_pos div {size}")
    also = F.when((F.col("_pos") % size) >= size - run_up, F.array(block, block + 1)).otherwise(F.array(block))
    spread = placed.select(F.struct("_pos", *rows.columns).alias("item"), key, F.explode(also).alias("block"))
    items = spread.groupBy(key, "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    lead = F.size(F.filter("items", lambda x: x["_pos"] < F.col("block") * size))
    # A group that ends with a block has a run-up for a block that is not there.
    return items.select(key, "block", lead.alias("lead"), "items").where(F.col("lead") < F.size("items"))


def plain(column: pa.Array) -> list:
    """``column.to_pylist()``, but structs and lists are made from whole columns, not taken apart value by value."""
    if pa.types.is_list(column.type):
        ends = column.offsets.to_numpy()
        values, at = plain(column.values.slice(ends[0], ends[-1] - ends[0])), (ends - ends[0]).tolist()
        rows = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    elif pa.types.is_struct(column.type) and column.type.num_fields:
        names = [f.name for f in column.type]
        rows = [dict(zip(names, values, strict=True)) for values in zip(*map(plain, column.flatten()), strict=True)]
    elif not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy().tolist()
    else:
        return column.to_pylist()
    return [r if ok else None for r, ok in zip(rows, column.is_valid().to_pylist(), strict=True)] if column.null_count else rows


def _run(blocks: DataFrame, fold: Fold, key: str, given: bool, state_type: pa.DataType, out_type: pa.DataType, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a block at a time: that bounds what is held as Python objects
                whose, block, lead, items, *entry = (plain(batch.column(c).slice(row, 1))[0] for c in range(batch.num_columns))
                state = entry[0] if given else (fold(items[:lead], None)[1] if lead else None)
                out, end = fold(items[lead:], state)
                held = [pa.array([whose], batch.column(0).type), pa.array([block], pa.int64()), pa.array([state], state_type), pa.array([end], state_type), pa.array([out], pa.list_(out_type))]
                yield pa.RecordBatch.from_arrays(held, names=[key, "block", "entry", "end", "out"])

    return blocks.mapInArrow(run, schema)


def carried_scan(rows: DataFrame, key: str, order: Sequence[str], fold: Fold, state: str, out: str, size: int = 8192, run_up: int = 64, written: bool = False) -> DataFrame:
    """``key, block, items, out``: blocks of rows (``items``, with ``_pos`` in front) and the fold's outputs beside them, one a row.

    ``fold`` starts from None at the head of a group. ``state`` and ``out`` are types of a state and an output, in DDL; ``written``: ``rows``
    are a table already and need not be written again.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], f"state {state}, out {out}").schema
    types = to_arrow_type(empty["state"].dataType), to_arrow_type(empty["out"].dataType)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, block long, entry {state}, end {state}, out array<{out}>"
    blocks = materialise(blocks_of(rows, key, order, size, min(run_up, size), written), "blocks")
    latest = materialise(_run(blocks, fold, key, False, *types, schema), "runs")
    in_order = Window.partitionBy(key).orderBy("block")
    while True:
        borders = latest.select(key, "block", "entry", F.lag("end").over(in_order).alias("before"))
        wrong = materialise(borders.where("NOT (entry <=> before)").select(F.col(key).alias("_key"), F.col("block").alias("_block"), F.col("before").alias("_entry")), "wrong_borders")
        if wrong.isEmpty():
            break
        these = (F.col(key) == F.col("_key")) & (F.col("block") == F.col("_block"))
        again = _run(blocks.join(wrong, these).select(key, "block", "lead", "items", "_entry"), fold, key, True, *types, schema)
        latest = materialise(latest.join(wrong, these, "left_anti").unionByName(again), "runs")
    held = latest.select(F.col(key).alias("_key"), F.col("block").alias("_block"), "out")
    both = blocks.join(held, (F.col(key) == F.col("_key")) & (F.col("block") == F.col("_block")))
    own = F.slice("items", F.col("lead") + 1, F.size("items"))
    return both.select(key, "block", own.alias("items"), "out")


def scanned_rows(scanned: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Blocks as rows again: ``columns`` of ``item`` (the given row) and ``out`` (the fold's output for it)."""
    pairs = F.arrays_zip(F.col("items").alias("item"), F.col("out").alias("out"))
    return scanned.select(F.explode(pairs).alias("p")).select("p.item", "p.out").select(*columns)
