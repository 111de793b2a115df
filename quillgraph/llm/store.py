"""Places that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a new local one, but not on a cluster, whose
    machines don't share it. What is checkpointed there goes when the driver's Python ends."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillgraph-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
        atexit.register(_remove, spark, sc._jsc.sc().getCheckpointDir().get())
    return named


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/quillgraph-{name}-{uuid.uuid4().hex}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh_dir whose files go when the driver's Python ends."""
    path = fresh_dir(spark, name)
    atexit.register(_remove, spark, path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, whatever executors are lost later."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(*frames: DataFrame) -> None:
    """Deletes the files of frames that came from cut_lineage and that nothing computed from here on reads: whatever was made
    of them must have been written out itself."""
    for df in frames:
        files = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if files.isDefined():
            _remove(df.sparkSession, files.get())


def sweep(spark: SparkSession) -> None:
    """Has the driver look for shuffles that no frame refers to any more, so that executors delete their files now and not
    when the driver's memory is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder as Parquet and read again; the files go when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Ids up to this number (some MB) are broadcast to leave out rows; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without_ids(df: DataFrame, ids: DataFrame, column: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose `column` is not among `ids`; null is never among them."""
    ids = cut_lineage(ids.select(F.col(ids.columns[0]).alias("_gone")).distinct())
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, df[column] == F.col("_gone"), "left_anti")
