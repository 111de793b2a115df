"""License scan by diagonal voting: rolling k-gram hashes are joined to template positions and counted by diagonal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.words import salted, with_gram_hashes, word_array

# Phrases that must stand word for word, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening sentences of public licenses, of which most must be there, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution": "cc",
}

#: Longest gram that votes.
MAX_GRAM = 3
#: Grams of all templates up to this number (each some 200 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 100_000


def templates(phrases: dict[str, str], notices: dict[str, str], k: int) -> list[tuple[int, list[str], str, int, bool]]:
    """(id, words, label, gram length, exact) of each template."""
    both = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for t, label in notices.items()]
    return [(i, t.split(), label, min(k, len(t.split())), exact) for i, (t, label, exact) in enumerate(both)]


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, k: int = MAX_GRAM, slack: int = 2, coverage: float = 0.6, doc_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_col, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score.

    Every k-gram of a text (shorter for shorter templates) that equals one of a template votes for the diagonal
    text position - template position. A phrase is found where all its grams vote for one diagonal. For a notice,
    neighbouring diagonals with votes, at most `slack` apart, are merged into a chain, so that words may be changed,
    missing or inserted time and again. A chain's span is then verified: of each gram of the notice the first place
    counts, and only those that stand behind all grams before them; they must be at least `coverage` of the notice's
    grams and begin within twice its length. score is 1 with a phrase, else the best share of a verified span, else 0.

    The templates' grams are broadcast if they are few enough. Null and empty texts have no words and no labels;
    repeated rows are scanned each on their own; of equal shares any is the best, the score being the same; very long
    texts are read whole.
    """
    known = templates(phrases, notices, k)
    sizes = sorted({t[3] for t in known})
    spark = docs.sparkSession
    rows = [(t, w[p : p + n], p, n, len(w) - n + 1, len(w), label, exact) for t, w, label, n, exact in known for p in range(len(w) - n + 1)]
    index = spark.createDataFrame(rows, "tid int, gram array<string>, tpos int, k int, grams int, long int, label string, exact boolean")
    index = index.withColumn("_h", F.transform("gram", lambda x: F.xxhash64(x)))
    parts = [with_gram_hashes(index.where(F.col("k") == n), "_f", "_h", n).select(F.xxhash64(F.get("_f", F.lit(0)), F.lit(n)).alias("fp"), "gram", "tid", "tpos", "k", "grams", "long", "label", "exact") for n in sizes]
    for x in parts[1:]:
        parts[0] = parts[0].unionByName(x)
    # Every document also has the entry 0, which keeps those without votes in the result.
    index = parts[0].unionByName(spark.createDataFrame([(0, [], -1, 0, 0, 0, 0, "", False)], parts[0].schema))

    own = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(F.col(doc_col), *(F.col(c) for c in keep if c != doc_col)).alias("_keep"), word_array(F.col(text_col)).alias("_w"))
    own = own.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    for n in sizes:
        own = with_gram_hashes(own, f"_f{n}", "_h", n).withColumn(f"_f{n}", salted(f"_f{n}", n))
    starts = [sum((F.size(f"_f{m}") for m in sizes[:i]), F.lit(0)) for i in range(len(sizes))]
    own = own.select("_row", "_keep", "_w", F.create_map(*(x for n, s in zip(sizes, starts) for x in (F.lit(n), s))).alias("_starts"), F.concat(*(f"_f{n}" for n in sizes), F.array(F.lit(0).cast("long"))).alias("_fps"))
    votes = own.select("_row", "_keep", "_w", "_starts", F.posexplode_outer("_fps").alias("_at", "fp")).join(F.broadcast(index) if len(rows) <= BROADCAST_GRAMS else index, "fp")
    pos = F.col("_at") - F.coalesce(F.element_at("_starts", F.col("k")), F.lit(0))
    votes = votes.where((F.col("tid") < 0) | (F.slice("_w", pos + 1, F.col("k")) == F.col("gram")))
    last = F.col("tid") < 0
    votes = votes.select("_row", F.when(last, F.col("_keep")).alias("_keep"), F.when(last, F.size("_w")).cast("long").alias("_n"), "tid", F.when(last, 0).otherwise(pos).cast("long").alias("pos"), F.when(last, 0).otherwise(pos - F.col("tpos")).cast("long").alias("diag"), "tpos", "grams", "long", "label", "exact")
    # One exchange serves all steps below; a group is at most one document.
    votes = votes.repartition("_row")
    own, by = Window.partitionBy("_row", "tid"), ("_row", "tid", "_chain")
    votes = votes.withColumn("_base", F.col("exact") & (F.col("tpos") == 0) & (F.count("*").over(Window.partitionBy("_row", "tid", "diag")) >= F.col("grams")))
    # Chains: votes in the order of their diagonals, a new chain after a gap.
    gap = F.coalesce(F.col("diag") - F.lag("diag").over(own.orderBy("diag", "tpos")), F.lit(slack + 1)) > slack
    votes = votes.withColumn("_gap", gap.cast("int")).withColumn("_chain", F.sum("_gap").over(own.orderBy("diag", "tpos").rowsBetween(Window.unboundedPreceding, 0)))
    # Of a gram's places in the chain the first; in order are those behind all grams before.
    first = F.col("pos") == F.min("pos").over(Window.partitionBy(*by, "tpos"))
    votes = votes.withColumn("_first", F.when(first, F.col("pos")))
    behind = F.max("_first").over(Window.partitionBy(*by).orderBy("tpos", "pos").rowsBetween(Window.unboundedPreceding, -1))
    votes = votes.withColumn("_spot", F.when(F.col("_first") > F.coalesce(behind, F.lit(-1)), F.col("_first")))
    votes = votes.groupBy("_row", "tid", "_chain", "grams", "long", "label", "exact").agg(
        F.first("_keep", ignorenulls=True).alias("_keep"),
        F.max("_n").alias("_n"),
        F.count_if("_base").alias("_bases"),
        F.min(F.when(F.col("_base"), F.col("diag"))).alias("_from"),
        F.max(F.when(F.col("_base"), F.col("diag"))).alias("_to"),
        F.count("_spot").alias("_spots"),
        (F.max("_spot") - F.min("_spot")).alias("_extent"),
    )
    base = F.col("_bases") > 0
    share = F.col("_spots") / F.greatest(F.col("grams"), F.lit(1))
    more = ~F.col("exact") & (F.col("tid") >= 0) & (F.col("_spots") >= F.col("grams") * coverage) & (F.col("_extent") < 2 * F.col("long"))
    out = votes.groupBy("_row").agg(
        F.first("_keep", ignorenulls=True).alias("_keep"),
        F.max("_n").alias("n_words"),
        F.sum("_bases").alias("n_base"),
        F.min("_from").alias("first_word"),
        F.max("_to").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(base | more, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(base, 1.0).when(more, share)), F.lit(0.0)).alias("score"),
    )
    return out.select("_keep.*", *out.columns[2:])
