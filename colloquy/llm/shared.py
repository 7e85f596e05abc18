"""Where intermediate tables live, and small helpers that every operator shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.work import materialise, new_path, shared_dir

__all__ = ["bucketed", "join_counted", "materialise", "new_path", "shared_dir", "table", "texts"]


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialise``, in files by the hash of ``key``: later groups and joins by it need no shuffle of this side.

    As many buckets as the session has shuffle partitions. Spark keeps bucketed files as tables only, so a table stands for
    them in the catalog until they are read.
    """
    spark = df.sparkSession
    path, entry = new_path(spark, name), f"colloquy_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(entry)
    out = spark.table(entry)
    out.schema  # resolved: the files stay when the table goes
    spark.sql(f"DROP TABLE {entry}")
    return out


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, hot: int = 500) -> DataFrame:
    """``rows`` joined with ``per_key``: one row for each value of the non-null ``keys``, ``count`` of them in ``rows``.

    Keys that hold at least one row in ``hot`` are ``hot`` at most, whatever the tables' size: those are broadcast and their rows
    stay where they are. All others meet in a shuffle, where no key is large. ``rows`` is read twice, so hand in a written table.
    """
    often = F.col(count) * hot >= (per_key.agg(F.sum(count)).first()[0] or 0)
    few = F.broadcast(per_key.where(often))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(per_key.where(~often), keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents; a null text counts as empty, other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
