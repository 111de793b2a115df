"""Retrieval and extraction quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision(retrieved: Column, expected: Column) -> Column:
    """0 where nothing was retrieved."""
    got = F.array_distinct(retrieved)
    return F.when(F.size(got) == 0, 0.0).otherwise(F.size(F.array_intersect(got, expected)) / F.size(got))


def recall(retrieved: Column, expected: Column) -> Column:
    """1 where nothing was expected, 0 where nothing was retrieved."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, retrieved)) / F.size(want))


def precision_recall(rows: DataFrame, group: str, item: str, retrieved: Column, expected: Column) -> DataFrame:
    """(group, precision, recall) by counts of distinct items, however many there are: an item is retrieved, or expected,
    where any of its rows is. 0 where nothing was retrieved, recall 1 where nothing was expected."""
    each = rows.groupBy(group, item).agg(F.coalesce(F.bool_or(retrieved), F.lit(False)).alias("r"), F.coalesce(F.bool_or(expected), F.lit(False)).alias("e"))
    n = each.groupBy(group).agg(F.count_if("r").alias("r"), F.count_if("e").alias("e"), F.count_if(F.col("r") & F.col("e")).alias("b"))
    return n.select(group, F.when(F.col("r") == 0, 0.0).otherwise(F.col("b") / F.col("r")).alias("precision"), F.when(F.col("e") == 0, 1.0).otherwise(F.col("b") / F.col("e")).alias("recall"))


def entity_recall(expected: DataFrame, entities: DataFrame) -> DataFrame:
    """Share of the expected (name, type) rows that some entity has, by name in lower case."""
    have = entities.select(F.lower("name").alias("_n")).distinct()
    hit = expected.join(have, F.lower("name") == F.col("_n"), "left")
    return hit.agg(F.coalesce(F.avg(F.col("_n").isNotNull().cast("double")), F.lit(1.0)).alias("recall"))


def report(results: DataFrame) -> DataFrame:
    """Averages of results (retrieved, expected, orphans): precision, recall, and the share of answers without orphans."""
    each = results.select(precision(F.col("retrieved"), F.col("expected")).alias("p"), recall(F.col("retrieved"), F.col("expected")).alias("r"), (F.size("orphans") == 0).cast("double").alias("f"))
    return each.agg(F.count("*").alias("questions"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("faithfulness"))
