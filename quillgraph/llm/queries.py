"""The operators of this folder applied to the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import decontaminate, langid, license_scan, mixing, near_dup, neighbours, pii, substring_dedup, token_count, warc
from quillgraph.llm.store import scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, one_in=20)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_passages(_table(spark, sf_dir, "documents"), window=50)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.learn(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Vocabulary of the query; its place is a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), token_count.read_vocabulary(vocabulary))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"), revisit_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), similarity=0.8)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM starts),
ks AS (SELECT DISTINCT k FROM win),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
pl AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS v FROM x),
hit AS (SELECT a.doc_id, win.item_id, a.i, a.k FROM (SELECT doc_id, i, k, array_to_string(v[1:k], ' ') AS g FROM pl, ks WHERE len(v) >= k) a JOIN win ON a.g = win.g AND a.k = win.k),
pos AS (SELECT DISTINCT doc_id, i + unnest(range(0, k)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
"""


_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SPACED} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING), ' ')) AS g, n FROM x),
f AS (SELECT g, min(doc_id) AS first FROM g WHERE i + 50 <= n GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM g JOIN f USING (g) WHERE g.i + 50 <= g.n AND f.first < g.doc_id),
k AS (SELECT x.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN x.x END, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda x: substring('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * (strpos('0123456789abcdef', x) - 1) + 1 AS BIGINT), 4)), '') AS bits FROM p),
f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (h)
"""

_OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_SPACED}) AS BIGINT) AS size, md5(concat_ws(chr(1), '17', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS wt FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / wt AS full_ FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(wt) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_, sum(source_size) OVER () * 1.5::DOUBLE AS all_, row_number() OVER q AS n FROM c WINDOW q AS (ORDER BY full_, source NULLS LAST)),
l AS (SELECT arg_min((all_ - caps) / left_, n) AS level FROM o WHERE full_ >= (all_ - caps) / left_),
t AS (SELECT source, source_size, least(cap, coalesce(level * wt, cap)) AS target FROM o CROSS JOIN l),
e AS (SELECT d.doc_id, d.h, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS goal, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, 0 AS copy, end_ AS last FROM e UNION ALL SELECT *, 1 AS copy, end_ + source_size AS last FROM e),
z AS (SELECT *, goal - (last - size) AS n, goal AS to_ FROM y WHERE last - size < goal AND goal < last
  UNION ALL SELECT *, last - goal AS n, last AS to_ FROM y WHERE last - size < goal AND goal < last
  UNION ALL SELECT *, size AS n, last AS to_ FROM y WHERE NOT (last - size < goal AND goal < last)),
r AS (SELECT *, sum(n) OVER (ORDER BY to_ / target NULLS LAST, source NULLS LAST, copy, h, to_ ROWS UNBOUNDED PRECEDING) AS running, (SELECT floor(1.5::DOUBLE * sum(size)) FROM d) AS budget FROM z)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(n, budget - running + n))) AS BIGINT) AS taken FROM r GROUP BY doc_id, h, size, source_size, target
"""


# Phrases, notices and the rule of their spans are written out here, so that a fault in the operator's shows.
_OP10_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
t(tid, w, label, exact) AS (VALUES
  (1, 'cc by', 'cc-by', true), (2, 'general public license', 'gpl', true), (3, 'all rights reserved', 'reserved', true),
  (4, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files', 'mit', false),
  (5, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'bsd', false),
  (6, 'licensed under the apache license version 2 0 you may not use this file except in compliance with the license', 'apache', false),
  (7, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license', 'gpl', false),
  (8, 'this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license', 'lgpl', false),
  (9, 'this source code form is subject to the terms of the mozilla public license', 'mpl', false),
  (10, 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted', 'isc', false),
  (11, 'this is free and unencumbered software released into the public domain', 'unlicense', false),
  (12, 'this work is licensed under a creative commons attribution', 'cc', false)),
tw AS (SELECT tid, string_split(w, ' ') AS w, label, exact FROM t),
p AS (SELECT tid, least(3, len(w)) AS k, len(w) AS m, len(w) - least(3, len(w)) + 1 AS grams, label, exact, w, unnest(range(0, len(w) - least(3, len(w)) + 1)) AS tpos FROM tw),
g AS (SELECT *, array_to_string(w[tpos + 1 : tpos + k], ' ') AS gram FROM p),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
pl AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v FROM x),
hit AS (SELECT a.doc_id, g.tid, g.m, g.grams, g.label, g.exact, g.tpos, a.i AS pos, a.i - g.tpos AS diag FROM (SELECT doc_id, i, k, array_to_string(v[1:k], ' ') AS gram FROM pl, (SELECT unnest([2, 3]) AS k) WHERE len(v) >= k) a JOIN g ON a.gram = g.gram AND a.k = g.k),
base AS (SELECT doc_id, label, diag FROM hit WHERE exact GROUP BY doc_id, tid, label, diag, grams HAVING count(*) = grams),
gap AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag, tpos) <= 2 THEN 0 ELSE 1 END AS new FROM hit WHERE NOT exact),
chain AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tid ORDER BY diag, tpos ROWS UNBOUNDED PRECEDING) AS chain FROM gap),
once AS (SELECT doc_id, tid, chain, m, grams, label, tpos, min(pos) AS pos FROM chain GROUP BY ALL),
sorted AS (SELECT *, coalesce(max(pos) OVER (PARTITION BY doc_id, tid, chain ORDER BY tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM once),
span AS (SELECT doc_id, label, count(*) / grams AS share FROM sorted WHERE pos > before GROUP BY doc_id, tid, chain, m, grams, label HAVING count(*) >= 0.6 * grams AND max(pos) - min(pos) < 2 * m),
f AS (SELECT doc_id, label, diag, true AS exact, 1.0::DOUBLE AS score FROM base UNION ALL SELECT doc_id, label, NULL, false, CAST(share AS DOUBLE) FROM span),
o AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(diag) AS first_word, max(diag) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN o USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_decontaminate, op2_substring_dedup, op3_language_id, op4_token_counts, op5_nearest, op6_warc, op7_mix_sources, op8_near_duplicates, op9_pii, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": _OP1_SQL, "op2_substring_dedup": _OP2_SQL, "op6_warc": _OP6_SQL, "op7_mix_sources": _OP7_SQL, "op10_license_scan": _OP10_SQL}
