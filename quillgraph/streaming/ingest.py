"""Continuous ingest with Structured Streaming: new files to processing log and graph rows, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions.text import size_priority
from quillgraph.operators.filters import unchanged_skipped
from quillgraph.operators.graph import latest
from quillgraph.schemas import PROCESSING_LOG
from quillgraph.sources.files import TYPES, classify

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, per_trigger: int = 2, types: dict[str, str] = TYPES) -> DataFrame:
    """New files below root; per_trigger and the trigger's interval bound the rate, the checkpoint takes each file once."""
    exts = "{" + ",".join(sorted(types)) + "}"
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{exts}").option("maxFilesPerTrigger", per_trigger).load(root)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")).withColumn("priority", size_priority("size"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The processing log, the last row of each file; empty before the first batch."""
    try:
        return latest(spark.read.schema(PROCESSING_LOG).parquet(path), "file_path", "seq")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], PROCESSING_LOG)
        raise


def ingest(files: DataFrame, log_path: str, checkpoint: str, process: Callable[[DataFrame, int], DataFrame], interval: str | None = None) -> StreamingQuery:
    """Runs process(files, batch) -> (path, document_id, cost_usd, error) on each batch of files that aren't logged as
    completed with the same hash, and appends to the log. A file that fails is logged as failed, keeps its last hash and
    document, and holds up no other. Without an interval it drains what is there and ends.

    A batch that is run again after a loss writes to the same folder of the log, so it counts once."""

    def batch(found: DataFrame, n: int) -> None:
        spark = found.sparkSession
        known = read_log(spark, log_path)
        good, _ = classify(found)
        todo = unchanged_skipped(good.withColumnRenamed("path", "file_path"), known).withColumnRenamed("file_path", "path").persist()
        done = process(todo, n).withColumnsRenamed({"path": "_path"})
        rows = todo.join(done, F.col("path") == F.col("_path")).join(known.select(F.col("file_path").alias("_f"), F.col("content_hash").alias("_h"), F.col("document_id").alias("_d")), F.col("path") == F.col("_f"), "left")
        failed = F.col("error").isNotNull()
        rows = rows.select(F.col("path").alias("file_path"), F.when(failed, F.col("_h")).otherwise(F.col("content_hash")).alias("content_hash"), F.unix_millis(F.current_timestamp()).alias("processed_at"), F.when(failed, "failed").otherwise("completed").alias("status"), F.col("error").alias("error_message"), F.when(failed, F.col("_d")).otherwise(F.col("document_id")).alias("document_id"), F.when(~failed, F.col("cost_usd")).alias("cost_usd"), F.lit(n).cast("long").alias("seq"))
        rows.write.mode("overwrite").parquet(f"{log_path}/batch={n}")
        todo.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dead_letters(spark: SparkSession, log_path: str) -> DataFrame:
    """Files whose last run failed."""
    return read_log(spark, log_path).where("status = 'failed'")


def windowed_costs(calls: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Cost and number of calls by type and window of event time, for streams and tables; later calls than `late` drop out."""
    own = calls.withWatermark("at", late) if calls.isStreaming else calls
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return own.groupBy(w, "call_type").agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("calls")).select(F.col("window.start").alias("start"), "call_type", "cost", "calls")


def budget_stream(calls: DataFrame, cap: float, key: str = "run_id") -> DataFrame:
    """Calls (run_id, at, call_id, cost_usd) with running cost and allowed, the state of each run kept across batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    def step(k: tuple, frames, state: GroupState):
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values(["at", "call_id"])
        running = rows["cost_usd"].cumsum() + total
        state.update((float(running.iloc[-1]),))
        yield pd.DataFrame({key: rows[key], "call_id": rows["call_id"], "running": running, "allowed": running - rows["cost_usd"] < cap})

    return calls.groupBy(key).applyInPandasWithState(step, f"{key} string, call_id long, running double, allowed boolean", "total double", "append", "NoTimeout")
