"""Pairs of similar vectors by blocks, against the expression over all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.vector import cosine, index_score
from quillgraph.operators import pairs, resolution, retrieval


def vectors(spark, n=150, seed=3):
    """Two types, one of which makes several blocks: near and equal vectors, and odd ones."""
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(n // 5)]
    rows = [(f"{i:04d}", "ab"[i % 10 == 0], [x + r.gauss(0, 0.4) * (i % 3 > 0) for x in base[i % len(base)]]) for i in range(n)]
    rows += [("x0", "a", [0.0] * 6), ("x1", "a", None), ("x2", "a", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("x3", "a", [1.0, 2.0]), ("x4", "a", [float("nan")] * 6), ("x5", None, base[0]), ("x6", "a", [1e200] * 6), ("x7", "a", [1e-200] * 6), ("x8", "a", [])]
    return spark.createDataFrame(rows, "id string, type string, embedding array<double>")


def plain(df, threshold):
    """(a, b, score) of all pairs of a type, both ways round."""
    a, b = (df.select(F.col("id").alias(x), "type", F.col("embedding").alias("v" + x)) for x in "ab")
    return a.join(b, "type").where("a <> b").select("a", "b", index_score(cosine(F.col("va"), F.col("vb"))).alias("score")).where(F.col("score") >= threshold)


def listed(df):
    return sorted((r["a"], r["b"], repr(r["score"])) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 40)


def test_best_of_each_row_are_those_of_all_pairs(spark, small_blocks):
    df = vectors(spark)
    for k in (1, 3, 200):
        first = Window.partitionBy("a").orderBy(F.desc("score"), "b")
        want = plain(df, 0.7).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
        assert listed(retrieval.nearest_pairs(df, 0.7, k)) == listed(want)
    copies = spark.createDataFrame([(i, "t", [1.0, 2.0]) for i in range(100)], "id long, type string, embedding array<float>")
    assert {(r["a"], r["b"]) for r in retrieval.nearest_pairs(copies, 0.9, 2).collect()} == {(i, b) for i in range(100) for b in [x for x in (0, 1, 2) if x != i][:2]}


def test_candidates_of_a_large_type_come_in_time(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, "t", [r.gauss(0, 1) for _ in range(32)]) for i in range(6000)], "id long, type string, embedding array<float>").repartition(2).cache()
    df.count()
    began = time.time()
    assert resolution.candidate_pairs(df, 0.6, 2).count() > 5000
    assert time.time() - began < 60  # 18 million pairs


def test_judged_pairs_are_the_candidates(spark, small_blocks):
    df = vectors(spark).withColumn("name", F.when(F.col("id") % 2 == 0, "even vector").otherwise("odd number"))
    found = resolution.candidate_pairs(df, 0.7, 2)
    assert not any(w in found._jdf.queryExecution().optimizedPlan().toString() for w in ("zip_with", "aggregate(zip"))  # no pair is scored as a row
    log = resolution.merge_log(resolution.judged(found, df, resolution.token_overlap_judge(0.5)), found)
    first = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    want = plain(df, 0.7).withColumn("n", F.row_number().over(first)).where("n <= 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    assert sorted((r["a"], r["b"]) for r in log.select("a", "b").collect()) == sorted(map(tuple, want.collect()))


def test_all_pairs_are_those_of_the_expression(spark, small_blocks):
    df = vectors(spark)
    for threshold in (0.5, 0.9):
        found = retrieval.similar_pairs(df, threshold)
        assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair is scored as a row
        assert listed(found) == listed(plain(df, threshold).where("a < b"))


def test_links_hang_together_as_the_pairs_do(spark, small_blocks):
    df = vectors(spark)
    for threshold in (0.7, 0.95):
        want = resolution.components(plain(df, threshold).select("a", "b"))
        assert sorted(map(tuple, resolution.components(retrieval.similar_links(df, threshold)).collect())) == sorted(map(tuple, want.collect()))
    copies = spark.createDataFrame([(i, "t", [1.0, 2.0]) for i in range(200)], "id long, type string, embedding array<float>")
    found = retrieval.similar_links(copies, 0.9)
    assert found.count() <= 200 * 6 and {r["root"] for r in resolution.components(found).collect()} == {0}
