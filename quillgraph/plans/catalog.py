"""Registered queries of the engine over the driver's tables, each with the SQL that it must agree with.

The tables stand in for the document graph: conversations are documents of paragraphs (turns), embeddings their vectors;
customers, suppliers, parts, nations and regions are entities, orders paragraphs, lineitems mentions and edges; events are
a ledger of calls; documents are texts and files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as X
from quillgraph.operators import context, evaluation, filters, graph, ledger, resolution, retrieval, sections, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- vectors -------------------------------------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("type"))


def _question(spark, d) -> list[float]:
    """The vector that is asked for: row 0."""
    return _vectors(spark, d).where("id = 0").select("embedding").first()[0]


_SCORED = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS e, label AS l FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS id, label AS type, (1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), e)) / 2 AS score, l FROM embeddings, q)"""


@query(f"WITH {_SCORED} SELECT id, type, round(score, 6) AS score FROM v ORDER BY v.score DESC, id LIMIT 10")
def vector_topk_cosine(spark, d):
    return retrieval.top_k(_vectors(spark, d), _question(spark, d), 10).select("id", "type", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED}, k AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 31) SELECT id, type, round(score, 6) AS score FROM k WHERE id <> 0 AND type = l")
def vector_topk_type_postfilter(spark, d):
    own = _vectors(spark, d)
    kind = own.where("id = 0").first()["type"]
    out = retrieval.top_k(own, _question(spark, d), 31, retrieval.Filters(equal={"type": kind}), mode="post")
    return out.where("id <> 0").select("id", "type", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT id, type, round(score, 6) AS score FROM v WHERE type IN (1, 2, 3) AND score >= 0.5 ORDER BY v.score DESC, id LIMIT 10")
def vector_topk_prefilter(spark, d):
    out = retrieval.top_k(_vectors(spark, d), _question(spark, d), 10, retrieval.Filters(among={"type": [1, 2, 3]}, min_score=0.5))
    return out.select("id", "type", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round((1 + list_cosine_similarity(a.v, b.v)) / 2, 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE (1 + list_cosine_similarity(a.v, b.v)) / 2 >= 0.65""")
def similarity_self_join(spark, d):
    return retrieval.similar_pairs(_vectors(spark, d), 0.65).select("a", "b", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE (1 + list_cosine_similarity(a.v, b.v)) / 2 >= 0.68),
r AS (SELECT a AS id, a AS root FROM p UNION SELECT p.b AS id, r.root FROM r JOIN p ON r.id = p.a)
SELECT id, min(root) AS root FROM r GROUP BY id""")
def component_canonicals(spark, d):
    return resolution.components(retrieval.similar_links(_vectors(spark, d), 0.68))


# ---- layout and hybrid search --------------------------------------------------------------------------------------


def _paragraphs(spark, d) -> DataFrame:
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("sequence_index"), "role", "text")


def _hits(spark, d) -> DataFrame:
    """Paragraphs (document_id, sequence_index, score) of the ten nearest vectors: vectors are dealt to conversations and
    their first three turns by id."""
    n = _paragraphs(spark, d).agg((F.max("document_id") + 1).alias("n"))
    top = retrieval.top_k(_vectors(spark, d), _question(spark, d), 10).crossJoin(F.broadcast(n))  # one row
    own = top.select((F.col("id") % F.col("n")).alias("document_id"), (F.col("id") % 3).alias("sequence_index"), "score")
    own = own.groupBy("document_id", "sequence_index").agg(F.max("score").alias("score"))
    return _paragraphs(spark, d).select("document_id", "sequence_index").join(F.broadcast(own), ["document_id", "sequence_index"])  # ten rows


_HITS = f"""{_SCORED}, n AS (SELECT max(conv_id) + 1 AS n FROM conversations), k AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 10),
h AS (SELECT c.conv_id AS document_id, c.turn AS sequence_index, max(score) AS score FROM k, n, conversations c WHERE c.conv_id = k.id % n.n AND c.turn = k.id % 3 GROUP BY ALL)"""


@query(f"WITH {_HITS} SELECT DISTINCT c.conv_id AS document_id, c.turn AS sequence_index, c.role FROM conversations c JOIN h ON c.conv_id = h.document_id AND abs(c.turn - h.sequence_index) <= 1")
def layout_expand_window1(spark, d):
    return retrieval.layout_expand(_hits(spark, d), _paragraphs(spark, d), 1).select("document_id", "sequence_index", "role").distinct()


@query(f"""WITH {_HITS}, x AS (SELECT DISTINCT c.conv_id AS document_id, c.turn AS sequence_index FROM conversations c JOIN h ON c.conv_id = h.document_id AND abs(c.turn - h.sequence_index) <= 1)
SELECT x.document_id, x.sequence_index, round(coalesce(h.score, 0.4), 6) AS score, CASE WHEN h.score IS NULL THEN 'expansion' ELSE 'vector' END AS origin FROM x LEFT JOIN h USING (document_id, sequence_index)""")
def hybrid_search_scored(spark, d):
    hits = _hits(spark, d)
    near = retrieval.layout_expand(hits, _paragraphs(spark, d), 1).select("document_id", "sequence_index").distinct()
    out = retrieval.hybrid_order(hits, near, ["document_id", "sequence_index"])
    return out.withColumn("score", F.round("score", 6))


@query("SELECT conv_id || '-' || turn AS src, conv_id || '-' || nxt AS dst FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def next_edges_paragraph(spark, d):
    own = _paragraphs(spark, d).withColumn("id", F.concat_ws("-", "document_id", "sequence_index"))
    return graph.next_edges(own, "document_id", "sequence_index", "id")


@query("""SELECT document_id, role, CAST(row_number() OVER (PARTITION BY document_id ORDER BY f, role) - 1 AS INTEGER) AS sequence_index
FROM (SELECT conv_id AS document_id, role, min(turn) AS f FROM conversations GROUP BY ALL)""")
def section_first_appearance(spark, d):
    return graph.first_appearance(_paragraphs(spark, d), "document_id", "role", "sequence_index")


@query("SELECT conv_id AS document_id, turn AS sequence_index, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS batch FROM conversations")
def batches_in_order(spark, d):
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("sequence_index"))
    return _paragraphs(spark, d).select("document_id", "sequence_index", F.floor((n - 1) / 3).alias("batch"))


_RANKED = "p AS (SELECT conv_id, turn, role, text, (length(text) % 100) / 100.0 AS combined FROM conversations)"


@query(f"""WITH {_RANKED},
r AS (SELECT *, row_number() OVER (ORDER BY combined DESC, conv_id, turn) AS position FROM p),
l AS (SELECT *, '[' || position || '] ("' || role || '"): ' AS head, ceil(length('[' || position || '] ("' || role || '"): ' || text) / 4.0) AS tokens FROM r),
u AS (SELECT *, sum(tokens) OVER (ORDER BY position) AS used FROM l),
o AS (SELECT *, sum(CASE WHEN used > 3200 THEN 1 ELSE 0 END) OVER (ORDER BY position) AS over_, 3200 - (used - tokens) AS room FROM u),
c AS (SELECT *, CAST(greatest(0, room * 4 - 80) AS BIGINT) AS n FROM o),
m AS (SELECT *, head || CASE WHEN length(text) <= n THEN text ELSE substring(text, 1, greatest(n - 1, 0)) || '…' END AS cut FROM c)
SELECT position, CASE WHEN over_ = 0 THEN head || text ELSE cut END AS line, over_ = 1 AS truncated FROM m WHERE over_ = 0 OR (over_ = 1 AND room > 60 AND ceil(length(cut) / 4.0) <= room)""")
def pack_context_budget(spark, d):
    own = _paragraphs(spark, d).withColumn("combined", (F.length("text") % 100) / 100.0)
    null = F.lit(None).cast("string")
    rows = own.select(F.col("text").alias("content"), null.alias("file_name"), null.alias("page_number"), F.col("role").alias("section_heading"), "combined", F.struct("document_id", "sequence_index").alias("ord"))
    none = spark.createDataFrame([], "source_name string, kind string, target_name string, evidence array<string>, confidence double")
    return context.assemble(rows, none, 4000).select(F.col("position").cast("long").alias("position"), "line", "truncated")


# ---- graph expansion -----------------------------------------------------------------------------------------------


def _edges(spark, d, once: bool = True) -> DataFrame:
    """edge_id, kind, src, dst: customers and suppliers in nations, nations in regions, suppliers of parts, these once or as
    often as they come."""
    one = lambda table, kind, a, x, b, y: _t(spark, d, table).select(F.lit(kind).alias("kind"), F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
    parts = one("lineitem", "SUPPLIES", "s", "l_suppkey", "p", "l_partkey")
    out = one("customer", "LOCATED_IN", "c", "c_custkey", "n", "c_nationkey").unionByName(one("supplier", "LOCATED_IN", "s", "s_suppkey", "n", "s_nationkey")).unionByName(one("nation", "PART_OF", "n", "n_nationkey", "r", "n_regionkey")).unionByName(parts.distinct() if once else parts)
    return out.withColumn("edge_id", F.concat("src", F.lit(">"), "dst"))


_EDGES = """e AS (SELECT 'LOCATED_IN' AS kind, 'c' || c_custkey AS s, 'n' || c_nationkey AS t FROM customer UNION ALL SELECT 'LOCATED_IN', 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'PART_OF', 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT DISTINCT 'SUPPLIES', 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
b AS (SELECT kind, s, t, s AS x, t AS y FROM e UNION ALL SELECT kind, s, t, t AS x, s AS y FROM e),
a AS (SELECT 'c' || c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)"""


def _richest(spark, d) -> DataFrame:
    return _t(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select(F.concat(F.lit("c"), "c_custkey").alias("id"))


@query(f"WITH {_EDGES} SELECT DISTINCT y AS id FROM a JOIN b ON a.id = b.x")
def semantic_expand_1hop(spark, d):
    return retrieval.semantic_expand(_richest(spark, d), _edges(spark, d), 1)[0]


@query(f"""WITH {_EDGES}, h1 AS (SELECT a.id AS anchor, b.* FROM a JOIN b ON a.id = b.x),
h2 AS (SELECT b.kind, b.s, b.t FROM h1 JOIN b ON h1.y = b.x WHERE NOT (b.s = h1.s AND b.t = h1.t AND b.kind = h1.kind))
SELECT DISTINCT s, kind, t FROM (SELECT s, kind, t FROM h1 UNION ALL SELECT s, kind, t FROM h2)""")
def semantic_expand_2hop_trail(spark, d):
    return retrieval.semantic_expand(_richest(spark, d), _edges(spark, d), 2)[1]


@query("""WITH a AS (SELECT o_orderkey AS a FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3), m AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
sup AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), start AS (SELECT a.a, m.p AS f FROM a JOIN m ON m.o = a.a),
reach AS (SELECT DISTINCT x.f, s2.p AS node FROM (SELECT DISTINCT f FROM start) x JOIN sup s1 ON s1.p = x.f JOIN sup s2 ON s2.s = s1.s WHERE s2.p <> x.f),
near AS (SELECT DISTINCT a, node FROM start JOIN reach USING (f)),
hit AS (SELECT near.a, near.node, m.o, row_number() OVER (PARTITION BY near.a, near.node ORDER BY m.o) AS n FROM near JOIN m ON m.p = near.node WHERE m.o <> near.a)
SELECT DISTINCT o AS id FROM hit WHERE n <= 5""")
def cross_expand_top5(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("sequence_index"), "o_totalprice")
    anchors = orders.orderBy(F.desc("o_totalprice"), "id").limit(3)
    mentions = _t(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("entity_id"), F.col("l_orderkey").alias("paragraph_id"))
    return retrieval.cross_expand(anchors, mentions, _edges(spark, d, once=False).where("kind = 'SUPPLIES'"), orders, hops=2, limit=5)


@query("SELECT l_orderkey AS paragraph_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS entities FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) GROUP BY l_orderkey")
def paragraph_entity_mentions(spark, d):
    mentions = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("paragraph_id"))
    ids = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return retrieval.paragraph_mentions(ids, mentions).select("paragraph_id", F.array_join(F.transform("entity_ids", lambda x: x.cast("string")), ",").alias("entities"))


@query("""WITH a AS (SELECT p_partkey AS p FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10),
m AS (SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS matches FROM lineitem JOIN a ON l_partkey = a.p GROUP BY 1)
SELECT o_orderkey AS id, coalesce(matches, 0) AS matches, round(0.7 * o_totalprice / 600007 + 0.3 * coalesce(matches, 0) / 10, 6) AS combined FROM orders LEFT JOIN m ON m.id = o_orderkey""")
def rank_paragraphs_alpha(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 600007).alias("vector_score"), F.col("o_orderkey").alias("ord"))
    anchors = _t(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.col("p_partkey").alias("id"))
    mentions = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("paragraph_id"))
    return retrieval.rank_paragraphs(orders, anchors, mentions, 0.7).select("id", "matches", F.round("combined", 6).alias("combined"))


_SUPPLIED = "r AS (SELECT 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, max(l_discount) AS confidence, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS ev FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_SUPPLIED}, a AS (SELECT 's' || s_suppkey AS id FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5)
SELECT '(' || source_id || ') --[SUPPLIES]--> (' || target_id || ') [evidence: ' || ev || ']' AS line FROM r WHERE source_id IN (SELECT id FROM a) OR target_id IN (SELECT id FROM a) ORDER BY confidence DESC, source_id, target_id LIMIT 25""")
def relationship_lines_cap25(spark, d):
    rel = _t(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id")).agg(F.max("l_discount").alias("confidence"), F.array(F.min(F.to_date("l_shipdate")).cast("string")).alias("evidence"))
    anchors = _t(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    best = context.relevant(rel, anchors).orderBy(F.desc("confidence"), "source_id", "target_id").limit(context.MAX_LINES)
    return best.select(X.relationship_line(F.col("source_id"), F.lit("SUPPLIES"), F.col("target_id"), F.col("evidence")).alias("line"))


@query("""SELECT c_custkey AS document_id, count(DISTINCT o_orderkey) AS paragraphs, count(l_orderkey) AS mentions, count(DISTINCT l_partkey) AS entities
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def layout_tree_counts(spark, d):
    own = _t(spark, d, "customer").select("c_custkey").join(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    own = own.join(_t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return own.groupBy(F.col("c_custkey").alias("document_id")).agg(F.count_distinct("o_orderkey").alias("paragraphs"), F.count("l_orderkey").alias("mentions"), F.count_distinct("l_partkey").alias("entities"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100")
def findnodes_filter_limit(spark, d):
    nodes = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment", F.array(F.lit("Customer")).alias("labels"))
    return filters.find_nodes(nodes, ["Customer"], {"c_mktsegment": "BUILDING"}).select("id", "name")


@query("""WITH g AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0) SELECT 'LOCATED_IN' AS kind, count(*) AS n FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM g)
UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT k FROM g))""")
def detach_delete_edges(spark, d):
    edges = _edges(spark, d).where(F.col("src").startswith("s"))
    gone = _t(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return graph.detach_delete(gone, edges, gone)[1].groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(c_name, s_name) AS name, round(greatest(coalesce(c_acctbal, s_acctbal), coalesce(s_acctbal, c_acctbal)), 2) AS vector_score
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def union_first_best_score(spark, d):
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("vector_score"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("vector_score"))
    return retrieval.merge_first(a, b).select("id", "name", F.round("vector_score", 2).alias("vector_score"))


# ---- upserts and resolution ----------------------------------------------------------------------------------------


def _companies(spark, d) -> DataFrame:
    """Entities named after sources with one of four company forms."""
    form = F.element_at(F.array(F.lit(" Inc."), F.lit(" Corp"), F.lit(", Company"), F.lit("")), (F.col("n_chars") % 4 + 1).cast("int"))
    own = _t(spark, d, "documents").select(F.concat("source", form).alias("name"), "doc_id", "lang")
    out = own.groupBy("name").agg(F.count("*").alias("mention_count"), F.min("doc_id").alias("first_seen"))
    return out.select(F.col("name").alias("id"), "name", F.lit("Organization").alias("type"), X.normalize_entity_name(F.col("name"), F.lit("Organization")).alias("normalized_name"), "mention_count", "first_seen")


def _normal(x: str) -> str:
    for _ in range(4):
        x = f"trim(regexp_replace(regexp_replace({x}, '{X.company_pattern()}', ''), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


_COMPANIES = f"""d AS (SELECT source || ['{" Inc."}', '{" Corp"}', '{", Company"}', ''][n_chars % 4 + 1] AS name, doc_id, lang FROM documents),
c AS (SELECT name AS id, name, count(*) AS mention_count, min(doc_id) AS first_seen, {_normal("lower(name)")} AS norm FROM d GROUP BY name),
m AS (SELECT id AS merged_id, first_value(id) OVER (PARTITION BY norm ORDER BY mention_count DESC, first_seen, id) AS canonical_id FROM c WHERE norm <> '')"""


@query(f"WITH {_COMPANIES} SELECT norm AS normalized_name, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM c GROUP BY norm HAVING count(*) > 1")
def normalize_org_groups(spark, d):
    out = _companies(spark, d).groupBy("normalized_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))
    return out.where("n > 1")


@query(f"WITH {_COMPANIES} SELECT * FROM m WHERE merged_id <> canonical_id")
def stage1_merge_mapping(spark, d):
    return resolution.exact_merges(_companies(spark, d))


@query(f"""WITH {_COMPANIES}, e AS (SELECT name AS s, lang AS t, min(doc_id) AS o, max(length(name)) / 100.0 AS confidence FROM d GROUP BY 1, 2)
SELECT coalesce(m.canonical_id, s) AS source_id, 'WRITES' AS type, t AS target_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS evidence, CAST(max(confidence) AS DOUBLE) AS confidence FROM e LEFT JOIN m ON m.merged_id = e.s GROUP BY 1, 3""")
def apply_merge_edges(spark, d):
    form = F.element_at(F.array(F.lit(" Inc."), F.lit(" Corp"), F.lit(", Company"), F.lit("")), (F.col("n_chars") % 4 + 1).cast("int"))
    own = _t(spark, d, "documents").select(F.concat("source", form).alias("source_id"), "doc_id", F.col("lang").alias("target_id"))
    edges = own.groupBy("source_id", F.lit("WRITES").alias("type"), "target_id").agg(F.min("doc_id").alias("ord"), F.array(F.min("doc_id").cast("string")).alias("evidence"), (F.max(F.length("source_id")) / 100.0).cast("double").alias("confidence"))
    out = resolution.redirect(edges, resolution.exact_merges(_companies(spark, d)), "ord")
    return out.select("source_id", "type", "target_id", F.array_join("evidence", ",").alias("evidence"), "confidence")


@query(f"""WITH {_COMPANIES} SELECT canonical_id AS id, string_agg(merged_id, '|' ORDER BY merged_id) FILTER (merged_id <> canonical_id) AS aliases, CAST(sum(mention_count) AS BIGINT) AS mention_count, min(first_seen) AS first_seen
FROM m JOIN c ON c.id = m.merged_id GROUP BY canonical_id""")
def absorb_merged_entities(spark, d):
    own = _companies(spark, d)
    out = resolution.absorb(own.withColumn("aliases", F.array().cast("array<string>")), resolution.exact_merges(own))
    return out.select("id", F.nullif(F.array_join("aliases", "|"), F.lit("")).alias("aliases"), "mention_count", "first_seen")


@query("""WITH o AS (SELECT source AS name, list_sort(list_distinct(list(CAST(n_chars % 7 AS VARCHAR)))) AS al, max(n_chars) / 50000.0 AS c, min(doc_id) AS f FROM documents WHERE lang = 'en' GROUP BY 1),
n AS (SELECT source AS name, list_sort(list_distinct(list(CAST(n_chars % 11 AS VARCHAR)))) AS al, max(n_chars) / 50000.0 AS c FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT coalesce(o.name, n.name) AS name, array_to_string(list_concat(list_filter(coalesce(n.al, []), lambda x: NOT list_contains(coalesce(o.al, []), x)), coalesce(o.al, [])), ',') AS aliases,
CAST(greatest(coalesce(o.c, n.c), coalesce(n.c, o.c)) AS DOUBLE) AS confidence, CASE WHEN n.name IS NULL THEN o.f ELSE 9999999 END AS last_seen FROM o FULL JOIN n ON o.name = n.name""")
def entity_upsert_merge(spark, d):
    docs = _t(spark, d, "documents")
    listed = lambda n: F.array_sort(F.collect_set((F.col("n_chars") % n).cast("string"))).alias("aliases")
    conf = (F.max("n_chars") / 50000.0).alias("confidence")
    props = F.lit(None).cast("map<string,string>").alias("properties")
    old = docs.where("lang = 'en'").groupBy(F.col("source").alias("name")).agg(listed(7), conf, F.min("doc_id").alias("last_seen"))
    old = old.select("*", F.lit("Source").alias("type"), F.col("name").alias("normalized_name"), props, F.lit(0).cast("long").alias("first_seen"), F.lit(1).alias("mention_count"))
    new = docs.where("lang <> 'en'").groupBy(F.col("source").alias("name")).agg(listed(11), conf).select("*", F.lit("Source").alias("type"), F.col("name").alias("normalized_name"), props)
    return graph.upsert_entities(old, new, 9999999).select("name", F.array_join("aliases", ",").alias("aliases"), F.col("confidence").cast("double").alias("confidence"), F.col("last_seen").cast("long").alias("last_seen"))


@query("""SELECT l_suppkey AS source_id, l_returnflag AS type, l_partkey AS target_id, string_agg(DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR), ',' ORDER BY CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS evidence, max(l_discount) AS confidence
FROM lineitem GROUP BY 1, 2, 3""")
def relationship_upsert_merge(spark, d):
    own = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("target_id"), F.array(F.to_date("l_shipdate").cast("string")).alias("evidence"), F.array().cast("array<string>").alias("source_documents"), F.col("l_discount").alias("confidence"), F.lit("").alias("properties"), F.struct(F.to_date("l_shipdate").alias("a"), "l_orderkey", "l_linenumber").alias("ord"))
    return graph.upsert_relationships(own, "ord").select("source_id", "type", "target_id", F.array_join("evidence", ",").alias("evidence"), "confidence")


@query("SELECT l_partkey AS entity_id, count(*) AS mention_count, count(DISTINCT l_orderkey) AS edges FROM lineitem GROUP BY 1")
def mention_counts(spark, d):
    own = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_orderkey").alias("paragraph_id"), F.lit("").alias("content"))
    edges, counts = graph.mention_edges(own)
    return counts.join(edges.groupBy("entity_id").agg(F.count("*").alias("edges")), "entity_id").select("entity_id", "mention_count", "edges")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, max(doc_id) AS processed_at FROM documents GROUP BY text")
def content_hash_dedupe(spark, d):
    own = _t(spark, d, "documents").select(X.content_hash("text").alias("content_hash"), F.col("doc_id").alias("processed_at"), "doc_id")
    return graph.merge_documents(own.limit(0), own).select("content_hash", "doc_id", "processed_at")


@query("""SELECT source || '/' || doc_id AS file_path FROM documents WHERE lang <> 'en' OR length(text) <> n_chars OR sha256(text || CASE WHEN n_chars < 1000 THEN 'x' ELSE '' END) <> sha256(text)""")
def incremental_skip_antijoin(spark, d):
    docs = _t(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("file_path"), "text", "lang", "n_chars")
    files = docs.select("file_path", X.content_hash(F.concat("text", F.when(F.col("n_chars") < 1000, "x").otherwise(""))).alias("content_hash"))
    log = docs.where("lang = 'en'").select("file_path", X.content_hash("text").alias("content_hash"), F.lit("completed").alias("status"))
    return filters.unchanged_skipped(files, log).select("file_path")


@query("SELECT user_id AS file_path, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS processed_at FROM events GROUP BY user_id")
def processing_log_latest(spark, d):
    log = _t(spark, d, "events").select(F.col("user_id").alias("file_path"), F.col("event_type").alias("status"), F.col("ts").alias("processed_at"), F.struct("ts", "event_id").alias("seq"))
    return graph.latest(log, "file_path", "seq").select("file_path", "status", "processed_at")


# ---- text ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate_by_doc(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents")
def word_count_by_doc(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.word_count("text").alias("words"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)"
_HEADS = rf"""{_LINES}, w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM l),
h AS (SELECT doc_id, seq, line, length(trim(line)) BETWEEN 1 AND 80 AND NOT regexp_matches(trim(line), '[.!?:;]$') AND regexp_matches(line, '\p{{L}}') AND (nxt IS NULL OR trim(nxt) = '') AS is_heading FROM w)"""


@query(f"WITH {_HEADS} SELECT doc_id, CAST(seq AS INTEGER) AS seq, line FROM h WHERE is_heading")
def heading_candidates(spark, d):
    own = sections.heading_candidates(sections.lines(_t(spark, d, "documents")))
    return own.where("is_heading").select("doc_id", "seq", "line")


@query(rf"""WITH {_HEADS}, f AS (SELECT *, trim(line) = '' AS blank, is_heading AND coalesce(lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY seq), true) AS head FROM h),
i AS (SELECT *, sum(CAST(blank OR head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM f)
SELECT doc_id, CAST(min(seq) AS INTEGER) AS first_seq, md5(trim(regexp_replace(string_agg(line, ' ' ORDER BY seq), '\s+', ' ', 'g'))) AS digest FROM i WHERE NOT blank AND NOT head GROUP BY doc_id, island""")
def paragraph_islands(spark, d):
    own = sections.paragraphs(sections.lines(_t(spark, d, "documents")))
    return own.select("doc_id", "first_seq", F.md5("paragraph").alias("digest"))


@query(f"""WITH RECURSIVE {_LINES}, t AS (SELECT doc_id, seq, CAST(ceil(length(line) / 4.0) AS BIGINT) AS n FROM l),
r AS (SELECT doc_id, seq, n AS used, 0 AS g FROM t WHERE seq = 0
UNION ALL SELECT t.doc_id, t.seq, CASE WHEN r.used > 0 AND r.used + t.n > 500 THEN t.n ELSE r.used + t.n END, CASE WHEN r.used > 0 AND r.used + t.n > 500 THEN r.g + 1 ELSE r.g END FROM r JOIN t ON t.doc_id = r.doc_id AND t.seq = r.seq + 1)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, g AS chunk FROM r""")
def chunk_pack_greedy(spark, d):
    own = _t(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: X.token_estimate(x)).alias("sizes"))
    return own.select("doc_id", F.posexplode(sections.greedy_groups(F.col("sizes"), 500)).alias("seq", "chunk"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS sentences FROM documents")
def sentence_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")).cast("long").alias("sentences"))


@query("SELECT doc_id, CASE WHEN n_chars <= 0 THEN 1 ELSE CAST(greatest(1, least(1000, round(log10(n_chars + 1) * 100))) AS INTEGER) END AS priority FROM documents")
def priority_for_size(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.size_priority("n_chars").alias("priority"))


@query(r"SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages")
def safe_filename_urls(spark, d):
    return _t(spark, d, "pages").select("page_id", X.safe_filename("url").alias("name"))


@query("SELECT p_type AS raw, upper(regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g')) AS type, count(*) AS n FROM part GROUP BY 1, 2")
def relationship_type_names(spark, d):
    return _t(spark, d, "part").groupBy(F.col("p_type").alias("raw"), X.relationship_type("p_type").alias("type")).agg(F.count("*").alias("n"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS h, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS p FROM pages)
SELECT page_id, len(h) AS headings, len(p) AS paragraphs, trim(regexp_replace(regexp_replace(coalesce(h[1], ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM h""")
def html_sections(spark, d):
    h, p = F.regexp_extract_all("html", F.lit(r"(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>"), 2), F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1)
    own = _t(spark, d, "pages").select("page_id", h.alias("h"), p.alias("p"))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.get("h", F.lit(0)), F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    return own.select("page_id", F.size("h").cast("long").alias("headings"), F.size("p").cast("long").alias("paragraphs"), title.alias("title"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([n_chars % 5, n_chars % 9, 1], lambda x: x NOT IN (1, 2, 3)))), ',') AS orphans FROM documents")
def orphan_citations(spark, d):
    answer = F.concat(F.lit("A ["), F.col("n_chars") % 5, F.lit("] and B ["), F.col("n_chars") % 9, F.lit("] and [1]."))
    own = X.orphan_citations(answer, F.array(F.lit(1), F.lit(2), F.lit(3)))
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.transform(own, lambda x: x.cast("string")), ",").alias("orphans"))


# ---- filters, tables, ledger, evaluation ---------------------------------------------------------------------------


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS n FROM lineitem WHERE 1 - 8 * l_discount >= 0.5),
r AS (SELECT l_orderkey AS c, l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS t, l_quantity / 50 AS q FROM lineitem)
SELECT r.c AS chunk_id, r.s AS source, r.t AS target FROM r WHERE q >= 0.6 AND EXISTS (SELECT 1 FROM e WHERE e.c = r.c AND e.n = r.s) AND EXISTS (SELECT 1 FROM e WHERE e.c = r.c AND e.n = r.t)""")
def confidence_filter_semi(spark, d):
    own = _t(spark, d, "lineitem")
    ents = own.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("name"), (1 - 8 * F.col("l_discount")).alias("confidence"))
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rels = own.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("source"), after.alias("target"), (F.col("l_quantity") / 50).alias("confidence"))
    return filters.confident(ents, rels)[1].select("chunk_id", "source", "target")


_RULES = [("**/fr/*.txt", "french"), ("src1/**", "first"), ("**/*.txt", "text")]


@query("""SELECT CASE WHEN lang = 'fr' THEN 'french' WHEN source = 'src1' THEN 'first' ELSE 'text' END AS domain, count(*) AS n FROM documents GROUP BY 1""")
def domain_tag_first_match(spark, d):
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return _t(spark, d, "documents").select(filters.domain_tag(path, _RULES).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id FROM part WHERE lower(p_name) LIKE '%d#1%' OR lower(p_brand) LIKE '%d#1%'")
def entity_contains_search(spark, d):
    own = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    return filters.name_contains(own, "D#1").select("id")


_COLUMNS = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_KIND = r"CASE WHEN regexp_matches(v, '^-?[0-9]+(\.[0-9]+)?$') THEN 'number' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'string' END"


@query(f"""WITH v AS ({' UNION ALL '.join(f"SELECT '{c}' AS header, CAST({c} AS VARCHAR) AS v FROM orders" for c in _COLUMNS)}), k AS (SELECT header, {_KIND} AS kind FROM v WHERE v <> ''),
n AS (SELECT header, count(*) FILTER (kind = 'number') AS a, count(*) FILTER (kind = 'date') AS b, count(*) FILTER (kind = 'string') AS c FROM k GROUP BY 1)
SELECT header, CASE WHEN greatest(a, b, c) / (a + b + c) < 0.5 THEN 'mixed' WHEN a = greatest(a, b, c) THEN 'number' WHEN b = greatest(a, b, c) THEN 'date' ELSE 'string' END AS column_type FROM n""")
def column_type_vote(spark, d):
    own = _t(spark, d, "orders").select(F.explode(F.array(*(F.struct(F.lit(c).alias("header"), F.col(c).cast("string").alias("v")) for c in _COLUMNS))).alias("x")).select("x.*")
    kind = F.when(F.col("v") == "", None).when(F.col("v").rlike(r"^-?[0-9]+(\.[0-9]+)?(E[0-9]+)?$"), "number").when(F.col("v").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(F.col("v").isNotNull(), "string")
    return tables.column_types(own.select("header", kind.alias("kind")), ["header"])


@query(f"WITH {_LINES} SELECT doc_id, CAST(seq AS INTEGER) AS seq FROM l WHERE seq < 8")
def sample_rows(spark, d):
    return tables.sample_rows(sections.lines(_t(spark, d, "documents")), "doc_id", "seq").select("doc_id", "seq")


def _calls(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("call_type"), F.col("user_id").alias("document_id"), F.col("value").cast("decimal(18,4)").alias("cost_usd"))


@query("""WITH c AS (SELECT event_type, user_id, CAST(value AS DECIMAL(18,4)) AS v FROM events)
SELECT CASE WHEN grouping(event_type) = 0 THEN 'call_type' WHEN grouping(user_id) = 0 THEN 'document_id' ELSE 'total' END AS dimension, coalesce(event_type, CAST(user_id AS VARCHAR), '') AS value, CAST(sum(v) AS DOUBLE) AS cost, count(*) AS calls
FROM c GROUP BY GROUPING SETS ((event_type), (user_id), ())""")
def cost_rollup_grouping_sets(spark, d):
    return ledger.rollup(_calls(spark, d), ["call_type", "document_id"]).withColumn("cost", F.col("cost").cast("double"))


@query("SELECT user_id AS document_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS cost FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def cost_top10_documents(spark, d):
    return ledger.top_documents(_calls(spark, d), "document_id").withColumn("cost", F.col("cost").cast("double"))


@query("SELECT round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 4) AS avg_click, round(coalesce(avg(value) FILTER (event_type = 'none'), 0), 4) AS avg_none FROM events")
def cost_avg_per_call(spark, d):
    own = _t(spark, d, "events").select(F.col("event_type").alias("call_type"), F.col("value").alias("cost_usd"))
    return ledger.average_per_call(own, "call_type", ["click", "none"]).select(F.round("avg_click", 4).alias("avg_click"), F.round("avg_none", 4).alias("avg_none"))


@query("""WITH c AS (SELECT event_id, CAST(value AS DECIMAL(18,4)) AS v, sum(CAST(value AS DECIMAL(18,4))) OVER (ORDER BY ts, event_id) AS r FROM events)
SELECT event_id, CAST(r AS DOUBLE) AS running, r - v < 20000 AS allowed, r - v < 16000 AND r >= 16000 AND r < 20000 AS warned FROM c""")
def budget_running_halt(spark, d):
    out = ledger.halted(_calls(spark, d), 20000, "ts", "event_id", "cost_usd")
    return out.select("event_id", F.col("running").cast("double").alias("running"), "allowed", "warned")


@query("""WITH x AS (SELECT lang, list(l.doc_id) FILTER (quality = 1) AS r, list(l.doc_id) FILTER (toxic = 0) AS e FROM labels l JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round(CASE WHEN len(coalesce(r, [])) = 0 THEN 0 ELSE len(list_intersect(r, coalesce(e, []))) / len(r) END, 6) AS prec, round(CASE WHEN len(coalesce(e, [])) = 0 THEN 1 ELSE len(list_intersect(e, coalesce(r, []))) / len(e) END, 6) AS rec FROM x""")
def eval_precision_recall(spark, d):
    own = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.precision_recall(own, "lang", "doc_id", F.col("quality") == 1, F.col("toxic") == 0).select("lang", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"))
