"""Connected components of a graph too large for one task: labels shrink to the smallest id by joins.

Edge cases: no links give no rows; links of a node with itself, with null ends, and repeated ones in either direction add
nothing; a node that only links to itself is no node; the result has each node once. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``); a component's id is its smallest node.

    Every round hooks each node to its smallest neighbour, follows the hooks twice, and contracts the links; a
    hub with very many links is only summed (a minimum) or is one side of a join that can be split. What is left
    after a round is written out, so neither lineage nor lost executors add up.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    rest = materialise(ordered(links), "links")
    labels: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        for _ in range(2):
            hook = materialise(hook, "hooks")
            over = hook.select(F.col("a").alias("to"), F.col("to").alias("on"))
            hook = hook.join(over, "to").select("a", F.col("on").alias("to"))
        hook = materialise(hook.select(F.col("a").alias("component"), "to"), "hooks")
        if labels is None:
            labels = hook.select(F.col("component").alias("node"), F.col("to").alias("component"))
        else:
            labels = materialise(labels.join(hook, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        on_a = hook.select(F.col("component").alias("a"), F.col("to").alias("ta"))
        on_b = hook.select(F.col("component").alias("b"), F.col("to").alias("tb"))
        rest = materialise(ordered(rest.join(on_a, "a").join(on_b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
