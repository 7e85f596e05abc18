"""Merkle manifest of a dataset: a digest of every row, trees over groups, a tree over the groups, and proofs by row.

Method: levels by windows. Nodes of a level are partitioned by group and parent index; an ordered ``collect_list`` over the
whole frame gives each node its run, from which come both the parent's preimage and the node's siblings. The first
node of each run stands for the parent in the next level. Going down again, each node takes its parent's
path and puts its own siblings before it. A run has ``fan_out`` nodes whatever the group's size, so a hot group is many tasks;
leaves get their places by ranges and running counts (``ordering.positions``), never by a window over a group.
Texts are read once and never shuffled: only digests travel.

Edge cases: a null field is ``-``, an empty one ``0:``. Rows with a null group are a group of their own, the first. Leaves ascend by key
(null first), rows that repeat a key by digest; equal rows are leaves of their own. A lone leaf is its group's root, a lone
group's root the root of all. An empty table gives no rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import materialise
from colloquy.operators.ordering import positions

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"
_NODE = ("grp", "pos", "n", "digest")


def row_digest(fields: Iterable[str | Column]) -> Column:
    """Lowercase hex sha256 of the fields, each ``-`` if null, else its UTF-8 bytes' number, a colon, and the value."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def _in_runs(nodes: DataFrame, fan_out: int) -> DataFrame:
    whole = Window.partitionBy("grp", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        nodes.withColumn("parent", F.expr(f"pos div {fan_out}"))
        .withColumn("run", F.collect_list("digest").over(whole))
        .withColumn("at", F.expr(f"int(pos % {fan_out})"))
    )


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """The next level; a group of one node passes it on as it is."""
    digest = F.when(F.col("n") > 1, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("digest"))
    firsts = _in_runs(nodes, fan_out).where("at = 0")
    return firsts.select("grp", F.col("parent").alias("pos"), F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"), digest.alias("digest"))


def _climb(nodes: DataFrame, fan_out: int) -> list[DataFrame]:
    """All levels from ``nodes`` (``grp, pos, n, digest``) to one node a group; at least one step."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = [nodes]
    while most > 1 or len(levels) == 1:
        levels.append(materialise(_parents(levels[-1].select(*_NODE), fan_out), f"level{len(levels)}"))
        most = -(-most // fan_out)
    return levels


def _descend(levels: list[DataFrame], known: DataFrame, fan_out: int) -> DataFrame:
    """The lowest level with ``path`` and the other columns of ``known``, which has them for the highest one (``grp, pos``)."""
    for k in range(len(levels) - 2, -1, -1):
        step = F.struct(
            F.array_join(F.slice("run", F.lit(1), F.col("at")), "").alias("before"),
            F.array_join(F.slice("run", F.col("at") + 2, F.lit(fan_out)), "").alias("after"),
        )
        own = F.when(F.col("n") > 1, F.array(step)).otherwise(F.expr(f"CAST(array() AS {_STEPS})"))
        above = known.withColumnsRenamed({"grp": "_grp", "pos": "_pos", "path": "_path"})
        placed = _in_runs(levels[k], fan_out).join(above, (F.col("grp") == F.col("_grp")) & (F.col("parent") == F.col("_pos")))
        known = placed.withColumn("path", F.concat(own, "_path")).drop("_grp", "_pos", "_path", "parent", "run", "at")
        if k:
            known = materialise(known.drop("n", "digest"), f"paths{k}")
    return known


def merkle_manifest(leaves: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """``leaves`` (``key, grp, leaf`` and further columns of other names than the result's and those of ``_NODE``) with ``pos, path, subroot, root``.

    ``path`` has a step for each level from the leaf to the root: the joined digests before and after the node in its run.
    """
    further = [c for c in leaves.columns if c not in ("key", "grp", "leaf")]
    # Null groups come first, the others by their bytes.
    rows = materialise(leaves.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit(""))), "leaves")
    placed = materialise(positions(rows, ["grp"], ["key", "leaf"], "pos", "n").withColumnRenamed("leaf", "digest"), "places")
    levels = _climb(placed, fan_out)

    tops = materialise(positions(levels[-1].select(F.col("grp").alias("of"), "digest"), [], ["of"], "pos", "n").withColumn("grp", F.lit("")), "subroots")
    over = _climb(tops, fan_out)
    summit = over[-1].select("grp", "pos", F.col("digest").alias("root")).withColumn("path", F.expr(f"CAST(array() AS {_STEPS})"))
    roots = materialise(_descend(over, summit, fan_out), "roots")
    known = roots.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    out = _descend(levels, known, fan_out).withColumnRenamed("digest", "leaf")
    return out.select("key", *further, "pos", "leaf", "path", "subroot", "root")


def proof_digest(path: str | Column = "path") -> Column:
    """Digest of all siblings of a path, from the leaf upward, left to right."""
    path = F.col(path) if isinstance(path, str) else path
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: str | Column, path: str | Column = "path") -> Column:
    """The root that a leaf digest and its siblings lead to."""
    leaf, path = (F.col(c) if isinstance(c, str) else c for c in (leaf, path))
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def document_leaves(docs: DataFrame, held: dict[str, Column] | None = None) -> DataFrame:
    """Leaves of documents by source; ``held`` replaces fields by what is found now, whose digest is the column ``found``."""
    fields = {c: F.col(c) for c in FIELDS}
    found = [row_digest((fields | held).values()).alias("found")] if held else []
    return docs.select(F.col("doc_id").alias("key"), F.col("source").alias("grp"), row_digest(fields.values()).alias("leaf"), *found)
