"""A session with the settings that the engine is tuned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quillgraph", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """On a cluster leave master and partitions unset: the first comes from spark-submit, and adaptive execution merges
    the default number of shuffle partitions down to what the data needs."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", partitions)
    return b.getOrCreate()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed, so that a lost executor costs no model call or round again. A cluster needs a
    checkpoint folder that all share; a local session is given one."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillgraph-"))
    return df.checkpoint()
