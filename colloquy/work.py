"""Where intermediate tables live: lineage ends at a table written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder takes its place if all runs on one machine; on a cluster that is an
    error, since executors would write where nobody else reads.
    """
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="colloquy-")
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/colloquy-{uuid.uuid4().hex[:12]}/{name}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            top = jvm.org.apache.hadoop.fs.Path(path).getParent()
            top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(top, True)
        except Exception:  # noqa: BLE001  the JVM is gone already; the folder belongs to the cluster's clean-up
            return


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
