"""Cutting lineage and finding shared scratch space.

Both use the shared folder the cluster names in ``spark.checkpoint.dir``. Only a
local master, where driver and executors share one disk, may fall back to a
temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet, inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that one piece of work writes to the shared folder, and removes when it has read them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read again; what was kept under this name before goes once that is done."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing will read any more; names without a table are passed over."""
        for name in names:
            if name in self.paths:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later steps neither recompute nor lose it."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet: large tables in a fraction of a checkpoint's bytes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Materialise ``df`` dealt out by ``keys``, which what is read from it still knows.

    A join or grouping on exactly these keys then moves no row of it. The layout is only kept
    if it is planned without adaptive changes, so these are off while it is written.
    """
    spark = df.sparkSession
    adaptive = "spark.sql.adaptive.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cut(df.repartition(n, *keys).sortWithinPartitions(*keys))
    finally:
        spark.conf.set(adaptive, before)


def spread(df: DataFrame, rows: int, *keys: str, per_part: int = 250_000) -> DataFrame:
    """``df`` dealt out by ``keys`` into parts of about ``per_part`` of its ``rows`` rows.

    Adaptive execution merges parts up to a size in compressed bytes, of which sorting and grouping
    text take a large multiple; it leaves parts alone whose number is given. Tables of a few
    parts are left to it.
    """
    n = -(-rows // per_part)
    if n <= 8:
        return df
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def few(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """``df``, broadcast where it is joined if its ``rows`` are at most ``most``, else left to adaptive execution."""
    return F.broadcast(df) if rows <= most else df


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, kept, and broadcast where it is joined if a count proves it has at most ``most`` rows.

    Beyond that the join is left to adaptive execution.
    """
    kept = cut(df)
    return few(kept, kept.count(), most)
