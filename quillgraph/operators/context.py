"""Packing ranked paragraphs and relationships into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.text import citation_line, relationship_line, token_estimate, truncate

#: Share of the budget kept for relationships, its least, and most relationship lines.
RESERVED, LEAST_RESERVED, MAX_LINES = 0.2, 200, 25


def paragraph_budget(max_tokens: int) -> int:
    return max_tokens - max(LEAST_RESERVED, int(max_tokens * RESERVED))


def assemble(ranked: DataFrame, relationships: DataFrame, max_tokens: int, order_col: str = "ord") -> DataFrame:
    """(part, position, line, tokens, truncated): the lines of the context, paragraphs first, then relationships.

    ranked: id, file_name, page_number, section_heading, content, combined, order_col. Paragraphs are taken by combined
    score until one overflows its share of the budget; that one is cut to fit if more than 60 tokens remain, and all after
    it are left out. relationships (those that touch an anchor): source_name, kind, target_name, evidence, confidence;
    at most 25, until the whole budget overflows.
    """
    budget = paragraph_budget(max_tokens)
    by = Window.orderBy(F.desc("combined"), order_col)
    line = lambda content: citation_line(F.col("position"), F.col("file_name"), F.col("page_number"), F.col("section_heading"), content)
    rows = ranked.withColumn("position", F.row_number().over(by)).withColumn("line", line(F.col("content"))).withColumn("tokens", token_estimate("line"))
    rows = rows.withColumn("used", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_over", F.sum(F.when(F.col("used") > budget, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("used") - F.col("tokens"))
    cut = line(truncate(F.col("content"), F.greatest(F.lit(0), left * 4 - 80).cast("int")))
    fits = (F.col("_over") == 1) & (left > 60) & (token_estimate(cut) <= left)
    took = rows.where((F.col("_over") == 0) | fits)
    took = took.select(F.lit("paragraph").alias("part"), "position", F.when(F.col("_over") == 0, F.col("line")).otherwise(cut).alias("line"), (F.col("_over") == 1).alias("truncated")).withColumn("tokens", token_estimate("line"))
    spent = took.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_spent"))

    order = Window.orderBy(F.desc("confidence"), "source_name", "kind", "target_name")
    rel = relationships.withColumn("position", F.row_number().over(order)).where(F.col("position") <= MAX_LINES)
    rel = rel.withColumn("line", relationship_line(F.col("source_name"), F.col("kind"), F.col("target_name"), F.col("evidence"))).withColumn("tokens", token_estimate("line"))
    rel = rel.withColumn("used", F.sum("tokens").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    rel = rel.crossJoin(F.broadcast(spent)).where(F.col("used") + F.col("_spent") <= max_tokens)  # one row
    rel = rel.select(F.lit("relationship").alias("part"), "position", F.concat(F.lit("- "), "line").alias("line"), F.lit(False).alias("truncated"), "tokens")
    return took.unionByName(rel)


def relevant(relationships: DataFrame, anchors: DataFrame) -> DataFrame:
    """Relationships with an anchor at either end, or all where there are no anchors."""
    ids = anchors.select(F.col("id").alias("_id")).distinct()
    none = ids.agg((F.count("*") == 0).alias("_none"))
    touched = relationships.join(ids.select(F.col("_id").alias("_s"), F.lit(True).alias("_hs")), F.col("source_id") == F.col("_s"), "left")
    touched = touched.join(ids.select(F.col("_id").alias("_t"), F.lit(True).alias("_ht")), F.col("target_id") == F.col("_t"), "left").crossJoin(F.broadcast(none))  # one row
    return touched.where(F.coalesce("_hs", F.lit(False)) | F.coalesce("_ht", F.lit(False)) | F.col("_none")).select(*relationships.columns)


def block(lines: DataFrame, question: str) -> DataFrame:
    """One row: the question, the paragraphs and the relationships as the text that a model is given."""
    part = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("position", "line"))))
    got = lines.agg(part("paragraph").alias("p"), part("relationship").alias("r"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("context_tokens"))
    joined = lambda c, sep: F.array_join(F.transform(c, lambda x: x["line"]), sep)
    tail = F.when(F.size("r") > 0, F.concat(F.lit("\nRelationships:\n"), joined("r", "\n"))).otherwise("")
    return got.select(F.concat(F.lit(f"Question: {question}\n\nContext:\n"), joined("p", "\n\n"), tail).alias("context_block"), "context_tokens")
