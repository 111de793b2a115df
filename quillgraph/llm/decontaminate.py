"""Benchmark decontamination by winnowing: fingerprints of both sides are joined and each hit is extended word by word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import salted, with_gram_hashes, with_winnowed, word_array

#: Fingerprint that every document has, so that those without hits stay in the result.
SENTINEL = 1
#: Benchmark fingerprints up to this number (each some 300 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _span(n) -> F.Column:
    """1 to n, or nothing if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))


def _short_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    for n in lengths:
        df = with_gram_hashes(df, f"_g{n}", "_h", n).withColumn(f"_g{n}", salted(f"_g{n}", n))
    return df


def benchmark_index(bench: DataFrame, window: int, k: int, item_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(fp, slot, glen, need, lead, ctx, items): the fingerprints of the benchmark, each with the words around it and
    the items that hold those words; and the lengths of items shorter than a window, which are fingerprinted whole."""
    items = bench.select(F.col(item_col).cast("string").alias("_item"), word_array(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    lengths = sorted(r[0] for r in items.where(F.size("_w") < window).select(F.size("_w")).distinct().collect())
    long = _hashed(items.where(F.size("_w") >= window))
    long = with_winnowed(with_gram_hashes(long, "_g", "_h", k), "_sel", "_g", window - k + 1)
    long = long.select("_item", "_w", F.posexplode_outer("_sel").alias("_p", "fp")).where(F.col("fp").isNotNull())
    lead = F.least(F.col("_p"), F.lit(window - k))
    rows = long.select("fp", F.lit(0).alias("slot"), F.lit(k).alias("glen"), F.lit(window).alias("need"), lead.alias("lead"), F.slice("_w", F.col("_p") - lead + 1, lead + window).alias("ctx"), "_item")
    short = _hashed(items.where(F.size("_w") < window))
    for slot, n in enumerate(lengths, 1):
        own = _short_hashes(short.where(F.size("_w") == n), [n])
        rows = rows.unionByName(own.select(F.get(f"_g{n}", F.lit(0)).alias("fp"), F.lit(slot).alias("slot"), F.lit(n).alias("glen"), F.lit(n).alias("need"), F.lit(0).alias("lead"), F.col("_w").alias("ctx"), "_item"))
    return rows.groupBy("fp", "slot", "glen", "need", "lead", "ctx").agg(F.array_sort(F.collect_set("_item")).alias("items")), lengths


def contaminated(docs: DataFrame, bench: DataFrame, window: int = 13, k: int = 8, one_in: int = 20, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of docs: doc_col, n_words, n_hit, longest, n_items, items, contaminated, and the columns named in keep.

    A window is `window` consecutive words of an item, or all of a shorter item. Both sides keep the minimum k-gram
    hash of every window - k + 1 neighbouring k-grams, so any shared window shares a fingerprint; each joined
    fingerprint is then compared word by word to both sides, and counts if it stretches over a whole window. A
    document is contaminated if the words hit make up at least one in
    `one_in` of its words; longest is the number of words of its longest hit.

    Null and empty texts have no words and are clean; null or empty items match nothing; an item without an id counts in
    n_hit, but not in n_items; repeated rows are judged each
    on their own; ties between equal hashes are all kept; an empty benchmark leaves every document clean. Other columns
    are ignored but for those in keep.
    """
    index, lengths = benchmark_index(bench, window, k, item_col, item_text_col)
    sentinel = docs.sparkSession.range(1).select(F.lit(SENTINEL).cast("long").alias("fp"), F.lit(-1).alias("slot"), F.lit(0).alias("glen"), F.lit(0).alias("need"), F.lit(0).alias("lead"), F.array().cast("array<string>").alias("ctx"), F.array().cast("array<string>").alias("items"))
    small = index.limit(broadcast_rows + 1).count() <= broadcast_rows
    index = index.unionByName(sentinel)

    own = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(F.col(doc_col), *(F.col(c) for c in keep if c != doc_col)).alias("_keep"), word_array(F.col(text_col)).alias("_w"))
    own = with_winnowed(with_gram_hashes(_hashed(own), "_g", "_h", k), "_sel", "_g", window - k + 1)
    own = _short_hashes(own, lengths)
    parts = ["_sel", *(f"_g{n}" for n in lengths)]
    starts = [sum((F.size(p) for p in parts[:i]), F.lit(0)) for i in range(len(parts))]
    own = own.select("_row", "_keep", "_w", F.array(*starts).alias("_starts"), F.concat(*parts, F.array(F.lit(SENTINEL).cast("long"))).alias("_fps"))
    anchors = own.select("_row", "_keep", "_w", "_starts", F.posexplode_outer("_fps").alias("_at", "fp")).where(F.col("fp").isNotNull())
    if small:
        hits = anchors.join(F.broadcast(index), "fp")
        pos = F.col("_at") - F.when(F.col("slot") >= 0, F.get("_starts", F.col("slot"))).otherwise(F.lit(0))
        first = F.greatest(pos - F.col("lead"), F.lit(0))
        hits = hits.select("_row", "_keep", F.size("_w").alias("_n"), "slot", "glen", "need", "lead", "ctx", "items", pos.alias("_p"), first.alias("_first"), F.slice("_w", first + 1, F.size("ctx")).alias("_d"))
    else:
        # The words around a fingerprint travel with it: at most 2 * window - k of them, whatever the document's length.
        slot = sum((F.when(F.col("_at") >= F.get("_starts", F.lit(i)), 1).otherwise(0) for i in range(1, len(parts))), F.lit(0))
        pos = F.col("_at") - F.get("_starts", slot)
        first = F.greatest(pos - (window - k), F.lit(0))
        last = F.col("fp") == SENTINEL
        hits = anchors.select("_row", "fp", F.when(last, F.col("_keep")).alias("_keep"), F.size("_w").alias("_n"), pos.alias("_p"), first.alias("_from"), F.slice("_w", first + 1, 2 * window - k).alias("_around"))
        none = F.array().cast("array<string>")
        ends = hits.where(F.col("fp") == SENTINEL).withColumns({"_around": none, "slot": F.lit(-1), "glen": F.lit(0), "need": F.lit(0), "lead": F.lit(0), "ctx": none, "items": none})
        hits = hits.where(F.col("fp") != SENTINEL).join(index.where(F.col("slot") >= 0), "fp").unionByName(ends)
        first = F.greatest(F.col("_p") - F.col("lead"), F.lit(0))
        hits = hits.select("_row", "_keep", "_n", "slot", "glen", "need", "lead", "ctx", "items", "_p", first.alias("_first"), F.slice("_around", first - F.col("_from") + 1, F.size("ctx")).alias("_d"))

    # In _d and ctx the fingerprint starts at _p - _first and at lead.
    d0 = F.col("_p") - F.col("_first")
    left = F.aggregate(_span(F.least(d0, F.col("lead"))), F.lit(0), lambda a, i: F.when((a == i - 1) & (F.get("_d", d0 - i) == F.get("ctx", F.col("lead") - i)), i).otherwise(a))
    right = F.aggregate(_span(F.least(F.size("_d") - d0, F.size("ctx") - F.col("lead")) - F.col("glen")), F.lit(0), lambda a, i: F.when((a == i - 1) & (F.get("_d", d0 + F.col("glen") + i - 1) == F.get("ctx", F.col("lead") + F.col("glen") + i - 1)), i).otherwise(a))
    same = F.slice("_d", d0 + 1, F.col("glen")) == F.slice("ctx", F.col("lead") + 1, F.col("glen"))
    hits = hits.select("_row", "_keep", "_n", "slot", "glen", "need", "items", "_p", left.alias("_l"), right.alias("_r"), same.alias("_same"))
    found = (F.col("slot") >= 0) & F.col("_same") & (F.col("_l") + F.col("glen") + F.col("_r") >= F.col("need"))
    span = F.when(found, F.struct((F.col("_p") - F.col("_l")).cast("long").alias("a"), (F.col("_p") + F.col("glen") + F.col("_r")).cast("long").alias("b")))
    # No filter on `found`: it would become a condition of the join, which has no generated code for it, and each exploded
    # row would be copied with all words of its document.
    hits = hits.select("_row", "_keep", "_n", span.alias("_s"), F.when(found, F.col("items")).alias("_items"))
    out = hits.groupBy("_row").agg(F.first("_keep", ignorenulls=True).alias("_keep"), F.max("_n").cast("long").alias("n_words"), F.array_sort(F.collect_set("_s")).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    n_hit = F.aggregate("_s", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(a["end"], s["a"]))).alias("n"), F.greatest(a["end"], s["b"]).alias("end")), lambda a: a["n"])
    longest = F.coalesce(F.array_max(F.transform("_s", lambda s: s["b"] - s["a"])), F.lit(0)).cast("long")
    out = out.select("_keep.*", "n_words", n_hit.alias("n_hit"), longest.alias("longest"), F.size("items").cast("long").alias("n_items"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
