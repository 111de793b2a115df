"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.store import cut_lineage

#: Hexadecimal digits of the hash that name a run of a source's shuffled order; runs are summed apart. 3 make 4096 runs.
RUN_DIGITS = 3


def text_size(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source_size per source -> target: weights are dealt to the sources by code point, null last, and share
    share * all sizes; no target is above most * source_size, and what is cut is dealt anew by weight.

    One row per source: sorted by how soon each is full, the level of weight at which all is dealt out is found from
    running sums."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (n % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    table = sizes.withColumn("_wt", w).withColumn("_cap", cap).withColumn("_full", F.col("_cap") / F.col("_wt"))
    order = Window.orderBy("_full", F.col("_source").asc_nulls_last())
    table = table.withColumns({"_caps": F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_left": F.sum("_wt").over(order.rowsBetween(0, Window.unboundedFollowing)), "_all": F.sum("source_size").over(whole) * share})
    level = (F.col("_all") - F.coalesce("_caps", F.lit(0.0))) / F.col("_left")
    # The first source whose own fill is above the level at its turn is not full, nor are those after it.
    table = table.withColumn("_level", F.when(F.col("_full") >= level, level))
    table = table.withColumn("_level", F.min(F.struct(F.when(F.col("_level").isNull(), 1).otherwise(0), F.row_number().over(order), "_level")).over(whole)["_level"])
    return table.select("_source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_wt"), F.col("_cap"))).alias("target"))


def queue(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), run_digits: int = RUN_DIGITS) -> DataFrame:
    """A row per document, copy and piece: doc_col, those in keep, size (of the document), source_size, target, copy, words
    (of the piece), start, finish; and _row, _source and _h, which name the document and settle ties.

    Each source's documents stand in an order drawn by hash, `most` times over. finish is the virtual time at which a
    piece has been served: its source's running size divided by the source's target; start, when its service begins. A
    copy that is being served at time 1, when its source has its target, is two pieces, one up to then and one after.
    Running sums are made in 16 ** run_digits runs of the hashed order and put together by the runs' totals, so no source
    is sorted in one task.
    """
    h = F.md5(F.concat_ws("\x01", F.lit(str(seed)), F.col(doc_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))))
    own = docs.select(F.struct(F.col(doc_col), *(F.col(c) for c in keep if c != doc_col)).alias("_keep"), F.col(source_col).alias("_source"), text_size(F.col(text_col)).alias("size"), h.alias("_h"))
    own = cut_lineage(own.withColumns({"_run": F.substring("_h", 1, run_digits), "_row": F.monotonically_increasing_id()}))
    # The table of runs has at most 16 ** run_digits rows per source; the null source joins by <=>.
    totals = own.groupBy("_source", "_run").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("_before", before)
    targets = source_targets(totals.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    t = targets.withColumnRenamed("_source", "_s2")
    totals = totals.join(t, F.col("_source").eqNullSafe(F.col("_s2"))).select(F.col("_source").alias("_s3"), F.col("_run").alias("_r3"), "_before", "source_size", "target")
    own = own.join(totals, F.col("_source").eqNullSafe(F.col("_s3")) & (F.col("_run") == F.col("_r3")))
    within = F.sum("size").over(Window.partitionBy("_source", "_run").orderBy("_h", "_row").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_end", F.col("_before") + within).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    end, goal = F.col("_end") + F.col("copy") * F.col("source_size"), F.floor("target")
    early = F.least(end, goal) - F.least(end - F.col("size"), goal)
    piece = lambda n, to: F.struct(n.cast("long").alias("n"), to.cast("long").alias("to"))
    late = F.col("size") - early
    pieces = F.when((early > 0) & (late > 0), F.array(piece(early, goal), piece(late, end))).otherwise(F.array(piece(F.col("size"), end)))
    own = own.withColumn("_p", F.explode(pieces))
    time = lambda x: F.when(F.col("target") > 0, x / F.col("target"))
    return own.select("_keep.*", "size", "source_size", "target", "copy", F.col("_p.n").alias("words"), time(F.col("_p.to") - F.col("_p.n")).alias("start"), time(F.col("_p.to")).alias("finish"), "_row", "_source", "_h")


#: The order of the mix: by virtual finish time, ties by source, copy and hash.
_ORDER = ("finish", "_source", "copy", "_h", "start", "_row")


def _cut(docs: DataFrame, share: float = 1.5, most: int = 2, **options) -> DataFrame:
    """The queue in _ORDER, with taken, the words of each piece that are within the budget, `share` of all words.

    The pieces are range-sorted over all tasks and written down; a piece's running total is that of the ranges before its
    own, a row each, and that within its range. Where it passes the budget the mix ends."""
    order = [F.col(c).asc_nulls_last() for c in _ORDER]
    own = queue(docs, share=share, most=most, **options).repartitionByRange(*order).sortWithinPartitions(*order)
    own = cut_lineage(own.withColumn("_range", F.spark_partition_id()))
    totals = own.groupBy("_range").agg(F.sum("words").alias("_sum"), F.sum(F.when(F.col("copy") == 0, F.col("words")).otherwise(0)).alias("_once"))
    ranges = Window.orderBy("_range")
    budget = F.floor(F.lit(float(min(share, most))) * F.sum("_once").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    totals = totals.select(F.col("_range").alias("_r"), (F.sum("_sum").over(ranges) - F.col("_sum")).alias("_before"), budget.alias("_budget"))
    running = F.sum("words").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = own.join(totals, F.col("_range") == F.col("_r")).withColumn("_running", F.col("_before") + running)
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.col("_budget") - F.col("_running") + F.col("words"))).cast("long")
    return own.withColumn("taken", taken).drop("_r", "_before", "_budget", "_running", "_range")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The pieces that are served, globally sorted by virtual finish time and cut where the budget is used up; columns as
    in queue(), and taken. Options are those of queue().

    Null texts and those without words have size 0 and are never taken; null sources are one source, the last; repeated
    rows count each, in any order, their sizes being equal; an empty table gives an empty result; columns not named are
    ignored. Reruns agree: the order depends on doc_id, text and source alone."""
    served = _cut(docs, **options).where(F.col("taken") > 0)
    order = [F.col(c).asc_nulls_last() for c in _ORDER]
    return served.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row", "_source", "_h")


def taken_by_document(docs: DataFrame, doc_col: str = "doc_id", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Per row of docs: doc_col, those in keep, size, source_size, target, and taken, the words of all its pieces that the
    mix takes. Each source takes its target, but for some words that the rounding of targets leaves, one a source. See
    mix() for nulls, ties and repeated rows."""
    names = (doc_col, *(c for c in keep if c != doc_col))
    own = _cut(docs, doc_col=doc_col, keep=keep, **options)
    out = own.groupBy("_row").agg(F.first(F.struct(*names)).alias("_keep"), *(F.first(c).alias(c) for c in ("size", "source_size", "target")), F.sum("taken").alias("taken"))
    return out.select("_keep.*", "size", "source_size", "target", "taken")
