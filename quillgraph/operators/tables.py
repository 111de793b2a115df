"""Spreadsheet columns: types by vote, and whether a sheet is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONSISTENT, SAMPLE = 0.5, 8


def vote(numbers: Column, dates: Column, strings: Column) -> Column:
    """Type of a column from counts of its cells: the commonest kind if it makes up half, numbers before dates before
    strings at a tie; else mixed; empty without cells."""
    top, all_ = F.greatest(numbers, dates, strings), numbers + dates + strings
    named = F.when(numbers == top, "number").when(dates == top, "date").otherwise("string")
    return F.when(all_ == 0, "empty").when(top / all_ >= CONSISTENT, named).otherwise("mixed")


def column_types(cells: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """(keys, column_type) of cells (keys, kind in number, date, string or null)."""
    n = lambda k: F.count_if(F.col(kind) == k)
    return cells.groupBy(*keys).agg(vote(n("number"), n("date"), n("string")).alias("column_type"))


def data_tables(types: DataFrame, sheet: str = "sheet", header: str = "header") -> DataFrame:
    """(sheet, is_table): at least two headers, none empty or twice, and half of the columns of one type."""
    fixed = F.count_if(~F.col("column_type").isin("mixed", "empty"))
    named = (F.count("*") > 1) & (F.count_if(F.coalesce(F.trim(header), F.lit("")) == "") == 0) & (F.count_distinct(F.trim(header)) == F.count("*"))
    return types.groupBy(sheet).agg((named & (fixed / F.count("*") >= CONSISTENT)).alias("is_table"))


def sample_rows(rows: DataFrame, group: str, order: str, n: int = SAMPLE) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= n).drop("_n")
