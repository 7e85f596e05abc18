"""Mixing sources to target weights by entropy balancing: document rates that meet token constraints, rounded into copies.

Method. Every source has a target of words. Among all document rates r within [0, ``cap``] that meet their source's target,
the ones nearest to 1 in relative entropy are r = min(cap, exp(lambda * z)), z the document's size over the mean of
its source: exponentially tilted, with one multiplier per source. The multipliers solve a convex dual, whose gradient in a source is
its words at these rates less its target. Newton steps run for all sources at once: each is a distributed sum of gradient and
curvature over classes of equal source and size, and a step that leaves its bracket is replaced by a bisection. Rates become whole
copies class by class, the largest documents first: each class takes the number of copies whose words come
nearest to its rate's plus what the larger classes left over, within what the smaller ones can still balance.

All sums run over classes (source, size), which grow with the longest text, not with the documents: a hot source or many
copies of one text are summed where they are read. Copies within a class go by a total order of ranges
(``ordering.positions``), so a class of any number of documents is many tasks, and reruns agree.

Edge cases: a null text has size 0; such documents keep one copy of no words. A null source is a source, the last. A source
without words has target 0. Repeated rows are documents of their own; equal ones may swap copies. One source takes all. An empty
table gives no rows. Columns other than ``doc_id``, ``source``, ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import textkernel as tk
from colloquy.llm.shared import join_counted, materialise
from colloquy.operators.ordering import positions

CAP = 3
WEIGHTS = (1, 2, 3)


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, key, source, size, text_hash``: words of each document; ``key`` is never null and orders sources by code point, null last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tk.blocks(batch.column("text")):
                first = tk.words(data, offs)[2]
                cols = [batch.column(c).slice(a, b - a) for c in ("doc_id", "key", "source")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first).astype(np.int64)), batch.column("text_hash").slice(a, b - a)], names=["doc_id", "key", "source", "size", "text_hash"])

    source = F.col("source").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("0"), source), F.lit("1")).alias("key"), source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return given.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, key string, source string, size long, text_hash long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (``key, source_size``) with ``target``: shares of all words by weight, none above ``cap`` times the source.

    What the capped sources leave over goes to the others by weight, until none is above. Only sums are held by the driver.
    """
    ranked = positions(sources, [], ["key"], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.expr(f"int(rank % {len(weights)}) + 1"))
    open_, rest = materialise(ranked.select("key", "source_size", weight.cast("long").alias("weight")), "weights"), None
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    over = F.lit(False)
    while True:
        # Sources are closed for good: the level only rises when others close.
        full, weight_left = open_.agg(F.sum(F.when(over, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not weight_left:
            share = F.lit(0.0)
        else:
            share = F.lit(float(words - full)) * F.col("weight") / F.lit(float(weight_left))
        if rest == weight_left or not weight_left:
            return open_.select("key", "source_size", F.when(over, cap * F.col("source_size").cast("double")).otherwise(share).alias("target"), over.alias("full"))
        rest, over = weight_left, over | (share > cap * F.col("source_size"))


def _exact_sum(words: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that reruns agree to the last bit."""
    return F.sum(words.cast("decimal(38,9)")).cast("double")


def tilts(classes: DataFrame, wanted: DataFrame, cap: int = CAP, tolerance: float = 1e-9, rounds: int = 80) -> DataFrame:
    """``key, mean, tilt`` for each source of ``wanted`` (``key, source_size, target, full``) that has words and room under the cap.

    ``classes`` has ``key, size, n_docs``. A source is done when its words miss the target by less than ``tolerance`` of it or a
    thousandth of a word; all are done within ``rounds``, for a bisection halves its bracket.
    """
    least = classes.where("size > 0").groupBy("key").agg(F.min("size").alias("least"), (F.sum(F.col("size") * F.col("n_docs")) / F.sum("n_docs")).alias("mean"))
    ratio, z_least = F.col("target") / F.col("source_size"), F.col("least") / F.col("mean")
    # At the ends of the bracket no document is above the wanted ratio, or all are at the cap.
    state = wanted.where("source_size > 0 AND NOT full AND target > 0").join(least, "key")
    state = state.select(
        "key", "target", "mean",
        F.when(ratio < 1, F.log(ratio) / z_least).otherwise(0.0).alias("low"),
        F.when(ratio < 1, 0.0).otherwise(F.log(F.lit(float(cap))) / z_least).alias("high"),
        F.lit(0.0).alias("tilt"),
        F.lit(float("inf")).alias("miss"),
    )
    state = materialise(state, "tilts")
    sized = materialise(classes.where("size > 0"), "classes")
    for _ in range(rounds):
        on = sized.join(state.select("key", "mean", "tilt"), "key")
        z = F.col("size") / F.col("mean")
        inner = F.exp(F.least(F.col("tilt") * z, F.lit(50.0))) < cap
        rate = F.when(inner, F.exp(F.col("tilt") * z)).otherwise(float(cap))
        held = F.col("size") * F.col("n_docs")
        sums = on.groupBy("key").agg(_exact_sum(held * rate).alias("words"), _exact_sum(F.when(inner, held * z * rate).otherwise(0.0)).alias("slope"))
        stepped = state.join(sums, "key").withColumn("gap", F.col("words") - F.col("target"))
        stepped = stepped.withColumns({
            "low": F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high")),
            "miss": F.abs("gap") / F.greatest("target", F.lit(0.001 / tolerance)),
            "newton": F.when(F.col("slope") > 0, F.col("tilt") - F.col("gap") / F.col("slope")),
        })
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        following = F.when(F.col("miss") <= tolerance, F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialise(stepped.select("key", "target", "mean", "low", "high", following.alias("tilt"), "miss"), "tilts")
        if state.where(F.col("miss") > tolerance).isEmpty():
            break
    return state.select("key", "mean", "tilt")


def round_classes(sizes: np.ndarray, docs: np.ndarray, rates: np.ndarray, target: float, cap: int) -> np.ndarray:
    """Copies of each class of a source, classes from the largest size down, so that the words taken end near ``target``."""
    words = sizes * docs
    below = words.sum() - np.cumsum(words)  # of the smaller classes
    out, left, owed = np.zeros(len(sizes), np.int64), float(target), 0.0
    for i, (size, n, rate) in enumerate(zip(sizes.tolist(), docs.tolist(), rates.tolist())):
        wish = rate * n + owed / size
        # What stays for the smaller classes is to be between nothing and all of them at the cap.
        at_least, at_most = np.ceil((left - cap * float(below[i])) / size), np.floor(left / size)
        if at_least <= at_most:
            wish = min(max(wish, at_least), at_most)
        copies = int(min(max(np.floor(wish + 0.5), 0), cap * n))
        owed += (rate * n - copies) * size
        left -= copies * size
        out[i] = copies
    return out


def entropy_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source, rate, copies`` of every document; ``taken`` is ``copies`` times ``size``."""
    sized = materialise(document_sizes(docs), "sizes")
    classes = materialise(sized.groupBy("key", "size").agg(F.count("*").alias("n_docs")), "size_classes")
    sources = materialise(classes.groupBy("key").agg(F.sum(F.col("size") * F.col("n_docs")).alias("source_size")), "source_sizes")
    wanted = materialise(targets(sources, weights, cap), "targets")
    solved = materialise(tilts(classes, wanted, cap), "solved")
    per_source = wanted.join(solved, "key", "left")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).when(F.col("tilt").isNull(), 0.0)
    tilted = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap)))
    rated = classes.join(per_source, "key").select("key", "size", "n_docs", "source_size", "target", rate.otherwise(tilted).alias("rate"))

    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        some = rows["size"].to_numpy() > 0
        copies = rows["n_docs"].to_numpy().copy()
        copies[some] = round_classes(rows["size"].to_numpy()[some], copies[some], rows["rate"].to_numpy()[some], float(rows["target"].iloc[0]), cap)
        return rows.assign(copies=copies)

    counted = rated.groupBy("key").applyInPandas(rounded, "key string, size long, n_docs long, source_size long, target double, rate double, copies long")
    counted = materialise(counted, "class_copies")

    # Of a class, all get the whole part, and the first ones in a scattered order one more.
    placed = positions(sized.withColumn("mixed", F.xxhash64("doc_id")), ["key", "size"], ["mixed", "doc_id", "text_hash"], "place")
    both = join_counted(materialise(placed, "places"), counted.withColumnRenamed("copies", "of_class"), ["key", "size"], "n_docs")
    copies = F.expr("of_class div n_docs + IF(place < of_class % n_docs, 1, 0)")
    return both.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
