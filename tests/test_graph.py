"""Upserts, expansion, ranking, packing and resolution on hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import context, evaluation, filters, graph, ledger, resolution, retrieval, tables

EDGES = "edge_id string, kind string, src string, dst string"


def edges(spark, *pairs):
    return spark.createDataFrame([(f"{a}{k}{b}", k, a, b) for a, k, b in pairs], EDGES)


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id string")


def got(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_trails_use_each_edge_once(spark):
    path = edges(spark, ("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d"))
    near, passed = retrieval.semantic_expand(ids(spark, "a"), path, 2)
    assert got(near) == ["b", "c"] and got(passed, "t") == ["b", "c"]
    assert got(retrieval.semantic_expand(ids(spark, "a"), path, 9)[0]) == ["b", "c", "d"]
    triangle = edges(spark, ("a", "R", "b"), ("b", "R", "c"), ("c", "R", "a"))
    assert got(retrieval.semantic_expand(ids(spark, "a"), triangle, 3)[0]) == ["a", "b", "c"]
    double = edges(spark, ("a", "R", "b"), ("a", "S", "b"))
    assert got(retrieval.semantic_expand(ids(spark, "a"), double, 2)[0]) == ["a", "b"]
    back = retrieval.trails(ids(spark, "d"), path, 3).select("node").distinct()
    assert got(back, "node") == ["a", "b", "c"]


def test_cross_expand_limits_each_neighbour(spark):
    mentions = spark.createDataFrame([("e", "p0")] + [("f", f"p{i}") for i in range(1, 9)] + [("f", "p1"), ("e", "p20")], "entity_id string, paragraph_id string")
    paragraphs = spark.createDataFrame([(f"p{i}", i) for i in range(30)], "id string, sequence_index int")
    out = retrieval.cross_expand(ids(spark, "p0"), mentions, edges(spark, ("e", "R", "f")), paragraphs, hops=1)
    assert got(out) == ["p1", "p2", "p3", "p4", "p5"]


def test_layout_and_unions(spark):
    p = spark.createDataFrame([("d", i) for i in range(6)] + [("e", 2)], "document_id string, sequence_index int")
    a = spark.createDataFrame([("d", 0), ("d", 1)], "document_id string, sequence_index int")
    assert got(retrieval.layout_expand(a, p, 1), "sequence_index") == [0, 1, 2]
    x = spark.createDataFrame([("1", 0.2, "first")], "id string, vector_score double, note string")
    y = spark.createDataFrame([("1", 0.9, "second"), ("2", None, "only")], "id string, vector_score double, note string")
    assert {tuple(r) for r in retrieval.merge_first(x, y).select("id", "vector_score", "note").collect()} == {("1", 0.9, "first"), ("2", None, "only")}


def test_ranking_follows_alpha(spark):
    p = spark.createDataFrame([("p1", 0.5, 0), ("p2", 0.9, 1), ("p3", 0.95, 2), ("p1", 0.5, 3)], "id string, vector_score double, ord int")
    mentions = spark.createDataFrame([("e1", "p1"), ("e2", "p1"), ("e1", "p2"), ("e1", "p1")], "entity_id string, paragraph_id string")
    order = lambda alpha: [r["id"] for r in retrieval.rank_paragraphs(p, ids(spark, "e1", "e2"), mentions, alpha).orderBy(F.desc("combined"), "ord").collect()]
    assert order(0.0)[0] == "p1" and order(1.0)[0] == "p3" and len(order(0.5)) == 3


RANKED = "id string, file_name string, page_number int, section_heading string, content string, combined double, ord int"
RELS = "source_id string, target_id string, source_name string, kind string, target_name string, evidence array<string>, confidence double"


@pytest.mark.parametrize("budget", [150, 300, 500, 1000])
def test_packing_keeps_to_the_budget(spark, budget):
    rows = spark.createDataFrame([(f"p{i}", "f", 1, None, "word " * (40 + i * 25), 1.0 - i / 10, i) for i in range(8)], RANKED)
    rel = spark.createDataFrame([("a", "b", "A", "T", f"B{i}", ["e"], 0.5) for i in range(40)], RELS)
    lines = context.assemble(rows, rel, budget).collect()
    text = [r for r in lines if r["part"] == "paragraph"]
    assert sum(r["tokens"] for r in text) <= max(0, context.paragraph_budget(budget)) and sum(r["tokens"] for r in lines) <= budget
    assert len([r for r in lines if r["part"] == "relationship"]) <= 25
    assert [r["position"] for r in sorted(text, key=lambda r: r["position"])] == list(range(1, len(text) + 1))
    if budget >= 300 and len(text) < 8:
        assert sum(r["truncated"] for r in text) <= 1


def test_a_long_paragraph_is_cut(spark):
    rows = spark.createDataFrame([("p", "f", 1, "H", "x" * 100_000, 1.0, 0)], RANKED)
    none = spark.createDataFrame([], RELS)
    r = context.assemble(rows, none, 400).first()
    assert r["truncated"] and r["line"].endswith("…") and r["tokens"] <= 200
    assert context.block(context.assemble(rows, none, 400), "Q?").first()["context_block"].startswith("Question: Q?\n\nContext:\n[1] (Document: f, p.1")
    assert context.relevant(spark.createDataFrame([("a", "b", "A", "T", "B", [], 0.5)], RELS), ids(spark, "z")).count() == 0
    assert context.relevant(spark.createDataFrame([("a", "b", "A", "T", "B", [], 0.5)], RELS), ids(spark)).count() == 1


ENT = "name string, type string, normalized_name string, aliases array<string>, confidence double, properties map<string,string>"


def test_entity_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", "T", "a", ["x"], 0.5, {"k": "old"}, 1, 1, 3)], ENT + ", first_seen long, last_seen long, mention_count long")
    new = spark.createDataFrame([("a", "T", "n", ["y", "x"], 0.9, {"k": "new"}), ("b", "T", "b", None, 0.7, {})], ENT)
    once = graph.upsert_entities(old, new, 7)
    a = once.where("name = 'a'").first()
    assert (a["aliases"], a["confidence"], a["properties"], a["last_seen"], a["first_seen"], a["mention_count"], a["normalized_name"]) == (["y", "x"], 0.9, {"k": "old"}, 7, 1, 3, "a")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(graph.upsert_entities(once, new, 7)) == key(once)


def test_other_upserts(spark):
    rel = spark.createDataFrame([("a", "T", "b", ["1"], ["d"], 0.3, {"k": "1"}, 0), ("a", "T", "b", ["2", "1"], ["d"], 0.9, {"k": "2"}, 1), ("a", "U", "b", [], [], 0.1, {}, 2)], "source_id string, type string, target_id string, evidence array<string>, source_documents array<string>, confidence double, properties map<string,string>, o int")
    r = graph.upsert_relationships(rel, "o").where("type = 'T'").first()
    assert (r["evidence"], r["source_documents"], r["confidence"], r["properties"]) == (["1", "2"], ["d"], 0.9, {"k": "1"})
    docs = spark.createDataFrame([("h", 1, "old")], "content_hash string, processed_at long, path string")
    new = spark.createDataFrame([("h", 5, "new"), ("i", 5, "other")], docs.schema)
    assert {tuple(x) for x in graph.merge_documents(docs, new).collect()} == {("h", 5, "old"), ("i", 5, "other")}
    assert graph.insert_new(docs, new, ["content_hash"]).count() == 2
    p = lambda k, v: spark.createDataFrame([(k, v)], "id string, properties map<string,string>")
    assert graph.merge_properties(p("a", {"x": "1", "y": "1"}), p("a", {"y": "2"})  , "id").first()["properties"] == {"x": "1", "y": "2"}
    v = lambda *r: spark.createDataFrame(list(r), "id string, embedding array<double>, embedding_model string")
    assert {(r["id"], r["embedding"][0], r["embedding_model"]) for r in graph.upsert_vectors(v(("a", [1.0], "m"), ("b", [2.0], "m")), v(("a", [9.0], None), ("c", [3.0], "n"))).collect()} == {("a", 9.0, "m"), ("b", 2.0, "m"), ("c", 3.0, "n")}
    assert got(graph.delete_by_id(v(("a", [1.0], "m"), ("b", [2.0], "m")), ids(spark, "a"))) == ["b"]
    n, e = graph.detach_delete(ids(spark, "a", "b", "c"), edges(spark, ("a", "R", "b"), ("b", "R", "c"), ("a", "R", "c")), ids(spark, "b"))
    assert got(n) == ["a", "c"] and e.count() == 1
    log = spark.createDataFrame([("f", "h1", "d1", 1), ("f", "h2", "d2", 2)], "file_path string, content_hash string, document_id string, seq long")
    assert graph.latest(log, "file_path", "seq").first()["content_hash"] == "h2"
    fail = graph.mark_failed(log, spark.createDataFrame([("f", "boom", 9, 3)], "file_path string, error_message string, processed_at long, seq long")).first()
    assert (fail["content_hash"], fail["document_id"], fail["status"], fail["cost_usd"]) == ("h2", "d2", "failed", None)
    s = spark.createDataFrame([("m", 8, 8, 1)], "embedding_model string, paragraph_dims int, entity_dims int, applied_at long")
    graph.check_schema_sentinel(s, "m", 8, 8)
    with pytest.raises(ValueError):
        graph.check_schema_sentinel(s, "other", 8, 8)


def test_endpoints_come_from_the_same_chunk(spark):
    ents = spark.createDataFrame([("c1", 0, "A", "Org"), ("c1", 1, "A", "Person"), ("c2", 0, "B", "Org")], "chunk_id string, ord int, name string, type string")
    rels = spark.createDataFrame([("c1", "A", "works at", "A"), ("c1", "A", "x", "B")], "chunk_id string, source string, relationship string, target string")
    found, lost = graph.resolve_endpoints(rels, ents)
    assert [(r["source_type"], r["type"]) for r in found.collect()] == [("Org", "WORKS_AT")] and lost.count() == 1


def test_resolution_of_a_cluster(spark):
    e = spark.createDataFrame([("1", "Acme Corp", 2, 5), ("2", "Acme Corporation", 9, 7), ("3", "Acme Inc.", 9, 6), ("4", "Other", 1, 1)], "id string, name string, mention_count long, first_seen long").withColumn("type", F.lit("Organization"))
    from quillgraph.functions.text import normalize_entity_name

    e = e.withColumn("normalized_name", normalize_entity_name("name", "type")).withColumn("aliases", F.array().cast("array<string>"))
    m = resolution.exact_merges(e)
    assert {tuple(r) for r in m.select("merged_id", "canonical_id").collect()} == {("1", "3"), ("2", "3")}
    a = resolution.absorb(e, m).where("id = '3'").first()
    assert (a["name"], a["aliases"], a["mention_count"], a["first_seen"]) == ("Acme Inc.", ["Acme Corp", "Acme Corporation"], 20, 5)
    rel = spark.createDataFrame([("1", "T", "4", ["a"], 0.4, 0), ("2", "T", "4", ["b"], 0.6, 1), ("1", "T", "2", ["c"], 0.5, 2)], "source_id string, type string, target_id string, evidence array<string>, confidence double, o int")
    out = {(r["source_id"], r["target_id"]): (r["evidence"], r["confidence"]) for r in resolution.redirect(rel, m, "o").collect()}
    assert out == {("3", "4"): (["a", "b"], 0.6), ("3", "3"): (["c"], 0.5)}
    v = e.withColumn("embedding", F.when(F.col("id") == "4", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.col("id").cast("double") / 100)))
    pairs = resolution.candidate_pairs(v)
    judged = resolution.judged(pairs, v, resolution.token_overlap_judge())
    assert judged.where("decision = 'same'").count() == 3
    assert {tuple(r) for r in resolution.canonicals(v, judged.where("decision = 'same'")).select("merged_id", "canonical_id").collect()} == {("1", "3"), ("2", "3")}
    assert resolution.merge_log(judged, m, dry_run=True).where("applied").count() == 0


def test_filters_tables_ledger_and_scores(spark):
    ents = spark.createDataFrame([("c", "A", 0.9), ("c", "B", 0.5)], "chunk_id string, name string, confidence double")
    rels = spark.createDataFrame([("c", "A", "A", 0.3), ("c", "A", "B", 0.9)], "chunk_id string, source string, target string, confidence double")
    assert filters.confident(ents, rels, 0.7, 0.6)[1].count() == 0 and filters.confident(ents, rels)[1].count() == 1
    path = lambda p, rules: spark.range(1).select(filters.domain_tag(F.lit(p), rules).alias("d")).first()["d"]
    assert path("finance/q3.pdf", [("**/*.pdf", "all"), ("finance/**", "finance")]) == "all" and path("x.txt", [("*.pdf", "a")]) is None
    assert filters.glob_regex("a?c*.t") == r"^a[^/]c[^/]*\.t$"
    cells = spark.createDataFrame([("s", "n", "number"), ("s", "n", "number"), ("s", "d", "date"), ("s", "d", "number"), ("s", "e", None)], "sheet string, header string, kind string")
    kinds = tables.column_types(cells, ["sheet", "header"])
    assert {r["header"]: r["column_type"] for r in kinds.collect()} == {"n": "number", "d": "number", "e": "empty"}
    assert tables.data_tables(kinds).first()["is_table"]
    calls = spark.createDataFrame([("x", "m", "A", 1_000_000, 0), ("x", "m", "A", 1_000_000, 0), ("y", "m", "B", 500_000, 0), ("y", "none", None, 5, 5)], "call_type string, model string, document_id string, input_tokens long, output_tokens long")
    priced = ledger.priced(calls, spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_million double, output_per_million double"))
    totals = {(r["dimension"], r["value"]): r["cost"] for r in ledger.rollup(priced, ["document_id"]).collect()}
    assert totals == {("document_id", "A"): 2.0, ("document_id", "B"): 0.5, ("total", ""): 2.5}
    assert ledger.top_documents(priced, "document_id").first()["document_id"] == "A"
    both = spark.createDataFrame([(["a", "b", "b"], ["b", "c"], [1]), ([], ["a"], []), (["a"], [], [])], "retrieved array<string>, expected array<string>, orphans array<int>")
    r = evaluation.report(both).first()
    assert (r["questions"], round(r["precision"], 4), round(r["recall"], 4), round(r["faithfulness"], 4)) == (3, 0.1667, 0.5, 0.6667)
    have = spark.createDataFrame([("ACME",)], "name string")
    assert evaluation.entity_recall(spark.createDataFrame([("acme",), ("x",)], "name string"), have).first()["recall"] == 0.5
    assert filters.find_nodes(spark.createDataFrame([("1", ["A"], 5), ("2", ["B"], 5)], "id string, labels array<string>, v int"), ["A"], {"v": 5}).count() == 1


def test_blocks_find_most_similar_pairs(spark):
    import random

    r = random.Random(0)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(f"{i}{c}", "t", [x + r.gauss(0, 0.15) for x in v]) for i, v in enumerate(base) for c in "ab"]
    df = spark.createDataFrame(rows, "id string, type string, embedding array<double>")
    pairs = lambda d: {(x["a"], x["b"]) for x in d.collect()}
    want, found = pairs(retrieval.similar_pairs(df, 0.92)), pairs(retrieval.blocked_pairs(df, 0.92, 8))
    assert found <= want and len(found) >= 0.9 * len(want) >= 30


def test_cross_expand_shuffles_no_mentions_or_edges(spark, monkeypatch):
    mentions = spark.createDataFrame([("e", "p0")] + [("f", f"p{i}") for i in range(1, 9)] * 2 + [("e", "p20"), ("g", "p0"), ("g", "p9")], "entity_id string, paragraph_id string")
    paragraphs = spark.createDataFrame([(f"p{i}", i) for i in range(30)], "id string, sequence_index int")
    twice = edges(spark, ("e", "R", "f"), ("e", "R", "f"), ("f", "S", "g"))
    find = lambda: retrieval.cross_expand(ids(spark, "p0"), mentions, twice, paragraphs, hops=2)
    few = find()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "edge_id" not in plan
    monkeypatch.setattr(retrieval, "FEW", 0)
    assert got(few) == got(find()) == ["p1", "p2", "p20", "p3", "p4", "p5", "p9"]
