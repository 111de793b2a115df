"""Cost of calls: prices, roll-ups and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.text import call_cost


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with cost_usd; models without a price cost nothing. prices: model, input_per_million, output_per_million."""
    p = prices.select(F.col("model").alias("_m"), "input_per_million", "output_per_million")
    out = calls.join(p, F.col("model") == F.col("_m"), "left")
    return out.withColumn("cost_usd", call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_per_million"), F.col("output_per_million"))).drop("_m", "input_per_million", "output_per_million")


def rollup(calls: DataFrame, dimensions: list[str], cost: str = "cost_usd") -> DataFrame:
    """(dimension, value, cost, calls) for each dimension, and for all as `total`, in one pass: each call counts once for
    every dimension where it isn't null."""
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions), F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")))
    each = calls.select(F.explode(rows).alias("x"), F.col(cost).alias("_c")).where(F.col("x.value").isNotNull())
    return each.groupBy(F.col("x.dimension").alias("dimension"), F.col("x.value").alias("value")).agg(F.sum("_c").alias("cost"), F.count("*").alias("calls"))


def top_documents(calls: DataFrame, document: str, k: int = 10, cost: str = "cost_usd") -> DataFrame:
    out = calls.where(F.col(document).isNotNull()).groupBy(document).agg(F.sum(cost).alias("cost"))
    return out.orderBy(F.desc("cost"), document).limit(k)


def average_per_call(calls: DataFrame, kind: str, kinds: list[str], cost: str = "cost_usd") -> DataFrame:
    """One row: the mean cost of each kind of call, 0 where there is none."""
    return calls.agg(*(F.coalesce(F.avg(F.when(F.col(kind) == k, F.col(cost))), F.lit(0.0)).alias(f"avg_{k}") for k in kinds))


def running_total(rows: DataFrame, at: str, tie: str, value: str, bucket: str = "hour") -> DataFrame:
    """Rows with `running`, the sum of value up to and with each in the order of (at, tie).

    No row set is ordered in one task: sums are made within each `bucket` of time, and the buckets' totals, few, are
    summed apart."""
    own = rows.withColumn("_b", F.date_trunc(bucket, at))
    totals = own.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = totals.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_b").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    return own.join(before, "_b").withColumn("running", F.col("_before") + within).drop("_b", "_before")


def halted(calls: DataFrame, cap: float, at: str, tie: str, cost: str, warn: float = 0.8) -> DataFrame:
    """Calls with running cost; allowed, whether the budget still held before; and warned, on the one call that takes the
    cost over `warn` of it while some is left."""
    out = running_total(calls, at, tie, cost)
    before = F.col("running") - F.col(cost)
    return out.withColumn("allowed", before < cap).withColumn("warned", (before < warn * cap) & (F.col("running") >= warn * cap) & (F.col("running") < cap))
