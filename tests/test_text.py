"""Text functions: golden rows and JavaScript's counting."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import prompts, text as X
from quillgraph.functions.vector import cosine, index_score


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


NAMES = [
    ("Microsoft Corp.", "Organization", "microsoft"), ("Microsoft Corporation", "Organization", "microsoft"), ("Microsoft Inc.", "Organization", "microsoft"), ("Hewlett-Packard Inc.", "Organization", "hewlett-packard"),
    ("Dr. Jane Wilson", "Person", "jane wilson"), ("Jane Wilson, PhD", "Person", "jane wilson"), ("Bob Jr.", "Person", "bob"), ("March 15, 2023", "Date", "2023-03-15"), ("Q3 2024", "Date", "q3 2024"),
    ("Café", "Organization", "cafe"), ("Zoë", "Person", "zoe"), ("   ", "Person", ""), ("visa", "Organization", "vi"), ("Acme Inc Co.", "Organization", "acme"), ("Straße ^ `x`", "Other", "straße x"), (None, "Person", ""),
]


def test_names(spark):
    df = spark.createDataFrame(NAMES, "name string, kind string, want string")
    for r in df.select("*", X.normalize_entity_name("name", "kind").alias("got")).collect():
        assert r["got"] == r["want"], r
    assert one(spark, X.normalize_entity_name(F.lit("visa"), F.lit("Organization"), strict_suffix=True)) == "visa"


def test_estimates_and_lines(spark):
    assert [one(spark, X.token_estimate(F.lit(s))) for s in ("", "a", "abcd", "abcde", "😀😀")] == [0, 1, 1, 2, 1]
    assert one(spark, X.truncate(F.lit("abcdef"), 4)) == "abc…" and one(spark, X.truncate(F.lit("abc"), 4)) == "abc"
    line = lambda f, p, h: one(spark, X.citation_line(F.lit(2), F.lit(f).cast("string"), F.lit(p).cast("int"), F.lit(h).cast("string"), F.lit("text")))
    assert line("f.pdf", 3, "H") == '[2] (Document: f.pdf, p.3, "H"): text' and line(None, None, None) == "[2]: text" and line("f", None, None) == "[2] (Document: f): text"
    rel = lambda e: one(spark, X.relationship_line(F.lit("A"), F.lit("T"), F.lit("B"), e))
    assert rel(F.array(F.lit("x" * 130))) == "(A) --[T]--> (B) [evidence: " + "x" * 119 + "…]" and rel(F.array().cast("array<string>")) == "(A) --[T]--> (B)"
    assert one(spark, X.entity_embedding_text(F.lit("Acme Corp"), F.lit("Organization"), F.array(F.lit("One."), F.lit("Two.")))) == "Acme Corp (Organization): One. Two."
    assert one(spark, X.chunk_embedding_text(F.array(F.lit("A"), F.lit("B")), F.lit("c"))) == "A > B\n\nc"
    assert [one(spark, X.size_priority(F.lit(n))) for n in (0, -1, 9, 10**12)] == [1, 1, 100, 1000]
    assert [one(spark, X.relationship_type(F.lit(s))) for s in ("works at", "a-b", "")] == ["WORKS_AT", "A_B", "RELATED_TO"]
    assert one(spark, X.orphan_citations(F.lit("A [1] and B [99] and C [42]."), F.array(F.lit(1)))) == [42, 99]
    assert one(spark, X.call_cost(F.lit(1_000_000), F.lit(500_000), F.lit(1.0), F.lit(2.0))) == 2.0
    assert [one(spark, X.csv_cell(F.lit(s).cast("string"))) for s in (None, 'a"b', "x,y", "2024-01-02 00:00:00")] == ["", '"a""b"', '"x,y"', "2024-01-02"]
    assert [one(spark, X.heading_level(F.lit(s))) for s in ("h2", "p")] == [2, None] and one(spark, X.slide_number(F.lit("ppt/slides/slide12.xml"))) == 12
    assert [one(spark, X.is_transient(F.lit(s).cast("int"), F.lit(m).cast("string"))) for s, m in ((429, None), (404, "x"), (None, "Network down"))] == [True, False, True]
    assert one(spark, X.safe_filename(F.lit("/a/b c?.txt"))) == "b_c_.txt"


def test_prompts(spark):
    got = one(spark, prompts.extraction_user(F.array(F.lit("A")), F.lit("S"), F.array(F.lit(1), F.lit(2)), F.lit("body")))
    assert got.splitlines() == ["Headings: A", "Section: S", "Pages: 1, 2", "", "Text:", "body"]
    got = one(spark, prompts.judge_user(F.lit("Person"), F.lit("x"), F.array(F.lit("y")), F.lit(None).cast("string"), F.lit("z"), F.array().cast("array<string>"), F.lit("c")))
    assert "A: x (also y)" in got and "Seen in: (nothing)" in got


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-10, 10), min_size=2, max_size=6))
def test_cosine_bounds(spark, v):
    c = one(spark, cosine(F.array(*map(F.lit, v)), F.array(*map(F.lit, v))))
    assert c is None or c == pytest.approx(1)
    assert one(spark, index_score(F.lit(-1.0))) == 0
