"""The pipeline's stages against brute force on a small corpus, and the registration of all queries."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillgraph.llm import pii, queries

POOLS = {"en": "the of and to in is that was he for it with as his on be at by".split(), "de": "der die und nicht ein zu mit von auf für ist im dem sich des".split()}


def sentence(n, lang, seed):
    r = random.Random(seed)
    return " ".join(r.choice(POOLS[lang]) + r.choice("abcdefgh") + str(r.randrange(50)) if r.random() < 0.4 else r.choice(POOLS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    item = sentence(40, "en", 999)
    rows = [(i, sentence(60 + i % 40, ["en", "de"][i % 2], i), ["en", "de"][i % 2], f"s{i % 3}") for i in range(200)]
    rows[10] = (10, rows[4][1] + " extra", "en", "s1")
    rows[11] = (11, rows[5][1], "de", "s2")
    rows[12] = (12, sentence(30, "en", 5000) + " " + item, "en", "s0")
    rows[13] = (13, "12 34 !!", "de", "s1")
    rows[14] = (14, None, None, None)
    # 13 words of the benchmark in a document of 2,000 others.
    long = sentence(2000, "en", 6000).split()
    rows[16] = (16, " ".join(long[:900] + item.split()[7:20] + long[900:]), "en", "s1")
    rows[17] = (17, " ".join(long[:900] + item.split()[7:19] + ["instead"] + long[900:1000]), "en", "s2")
    rows[15] = (15, rows[15][1] + " write to jane@x.org", "de", "s0")
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_decide_as_planted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids, gone = [set(range(200))], []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == list(pipeline.COLUMNS)
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        gone.append(ids[-2] - ids[-1])
    assert gone == [{13, 14}, {10, 11}, {12, 16}, set()]
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert kept[15]["text"].endswith("write to [EMAIL]") and kept[15]["n_chars"] == len(kept[15]["text"])
    own = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r["text"] == own[i] for i, r in kept.items() if not pii.base_spans(own[i]))
    mix = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in mix} == set(kept)
    assert sum(r["taken"] for r in mix) == pytest.approx(1.5 * sum(r["size"] for r in mix), abs=3)


def test_run_gives_the_mix_of_what_is_left(spark, sf_dir):
    got = {r["doc_id"]: r for r in pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(range(200)) - {10, 11, 12, 13, 14, 16}
    assert all(r["size"] == len(spark_text.split()) for r, spark_text in ((got[i], t) for i, t in ((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()) if i in got and i != 15))


def test_stages_take_empty_tables_repeated_rows_and_nulls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    twice = docs.where("doc_id in (20, 21)").unionByName(docs.where("doc_id in (20, 21)")).unionByName(docs.where("doc_id = 22").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    kept = pipeline.near_duplicates(spark, twice, sf_dir).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 20, 21]
    assert pipeline.personal_data(spark, twice, sf_dir).count() == 5


def test_stages_take_clashing_columns_and_long_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id between 20 and 60")
    long = sentence(150_000, "en", 77)
    docs = docs.unionByName(spark.createDataFrame([(900, long, "en", "s0", len(long)), (901, long, "en", "s0", len(long))], docs.schema))
    names = ("_keep", "_row", "_text", "_w", "_h", "_key", "_id", "id", "key", "size", "taken", "target", "longest", "class_id", "n")
    for name, stage in pipeline.STAGES:
        plain = stage(spark, docs, sf_dir)
        clashing = stage(spark, docs.select("*", *(F.lit("x").alias(c) for c in names)), sf_dir)
        assert plain.columns == clashing.columns
        assert sorted(map(str, plain.collect())) == sorted(map(str, clashing.collect()))
        kept = {r["doc_id"] for r in plain.select("doc_id").collect()}
        assert 900 in kept and (901 in kept) == (name != "near_duplicates")


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
