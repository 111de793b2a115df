"""Questions over the graph: hybrid search, and cited answers from packed context.

Anchors are cut to at most a hundred rows by top_k and kept, as three expansions read them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.prompts import ANSWER_RULES
from quillgraph.functions.text import orphan_citations
from quillgraph.operators import context, retrieval


@dataclass
class GraphTables:
    """paragraphs: id, document_id, file_name, page_number, section_heading, sequence_index, content, embedding.
    entities: id, name, type, embedding. mentions: entity_id, paragraph_id. edges (entity to entity): edge_id, kind, src,
    dst, evidence, confidence."""

    paragraphs: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Request:
    paragraph_top_k: int = 10
    entity_top_k: int = 10
    hops: int = 2
    window: int = 1
    max_context_tokens: int = 4000
    alpha: float = 0.7
    paragraph_filters: retrieval.Filters = retrieval.Filters()
    entity_filters: retrieval.Filters = retrieval.Filters()
    most_k: int = 50

    def __post_init__(self):
        for name, lo, hi in (("paragraph_top_k", 1, self.most_k), ("entity_top_k", 1, self.most_k), ("hops", 1, 4), ("window", 0, 5), ("max_context_tokens", 1, 16_000)):
            if not lo <= getattr(self, name) <= hi:
                raise ValueError(f"{name} goes from {lo} to {hi}")


def _anchored(t: GraphTables, vector: list[float], r: Request) -> tuple[DataFrame, DataFrame]:
    p = retrieval.top_k(t.paragraphs, vector, r.paragraph_top_k, r.paragraph_filters)
    e = retrieval.top_k(t.entities, vector, r.entity_top_k, r.entity_filters, mode="post")
    return p.persist(), e.persist()


def _expanded(t: GraphTables, p: DataFrame, e: DataFrame, r: Request) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Layout and cross paragraphs, neighbour ids, and the edges passed."""
    rows = t.paragraphs.drop("embedding")
    layout = retrieval.layout_expand(p, rows, r.window)
    near, passed = retrieval.semantic_expand(e, t.edges.select("edge_id", "kind", "src", "dst"), r.hops)
    cross = rows.join(retrieval.cross_expand(p, t.mentions, t.edges.select("edge_id", "kind", "src", "dst"), rows, r.hops), "id", "left_semi")
    return layout, cross, near, passed


def hybrid_search(t: GraphTables, vector: list[float], r: Request = Request(paragraph_top_k=15, entity_top_k=15, most_k=100)) -> dict[str, DataFrame]:
    """paragraphs and entities (id, score, origin), anchors before expansions, and relationships by confidence."""
    p, e = _anchored(t, vector, r)
    layout, cross, near, passed = _expanded(t, p, e, r)
    paragraphs = retrieval.hybrid_order(p, layout.select("id").unionByName(cross.select("id")).distinct())
    entities = retrieval.hybrid_order(e, near)
    rel = t.edges.join(passed.select(F.col("s").alias("src"), "kind", F.col("t").alias("dst")), ["src", "kind", "dst"], "left_semi")
    return {"paragraphs": paragraphs.orderBy(F.desc("score"), "id"), "entities": entities.orderBy(F.desc("score"), "id"), "relationships": rel.select("src", "kind", "dst", F.col("confidence").alias("score")).orderBy(F.desc("score"), "src", "kind", "dst")}


def stub_answer(prompt: tuple[str, str]) -> dict:
    """Stands in for a model: repeats the first numbered line."""
    line = next((x for x in prompt[1].splitlines() if x.startswith("[")), "")
    return {"answer": f"{line.split(': ', 1)[-1][:200]} [1]" if line else "The context doesn't say.", "citations": [1] if line else [], "confident": bool(line)}


def answer_question(t: GraphTables, question: str, embed: Callable[[str], list[float]], answer: Callable[[tuple[str, str]], dict] = stub_answer, r: Request = Request()) -> dict:
    """Retrieve, expand, rank, pack, answer and check: the answer, its sources, orphan citations and a trace. The only rows
    that reach the driver are the lines packed into the context, which its token budget bounds."""
    if not 1 <= len(question) <= 4000:
        raise ValueError("a question has 1 to 4000 characters")
    began = time.time()
    p, e = _anchored(t, embed(question), r)
    layout, cross, _, passed = _expanded(t, p, e, r)
    own = lambda df, n: df.select("id", "document_id", "file_name", "page_number", "section_heading", "sequence_index", "content", (F.col("score") if "score" in df.columns else F.lit(None).cast("double")).alias("vector_score"), F.lit(n).alias("list"))
    merged = retrieval.merge_first(own(p, 0), own(layout, 1), own(cross, 2)).withColumn("ord", F.struct("list", "document_id", "sequence_index", "id"))
    ranked = retrieval.rank_paragraphs(merged, e, t.mentions, r.alpha)
    # Every line takes a token at least, so no more rows than the budget has tokens can be packed.
    ranked = ranked.orderBy(F.desc("combined"), "ord").limit(r.max_context_tokens)
    names = t.entities.select(F.col("id").alias("_i"), "name")
    rel = t.edges.join(passed.select(F.col("s").alias("src"), "kind", F.col("t").alias("dst")), ["src", "kind", "dst"], "left_semi").withColumnsRenamed({"src": "source_id", "dst": "target_id"})
    rel = context.relevant(rel, e).orderBy(F.desc("confidence"), "source_id", "kind", "target_id").limit(context.MAX_LINES)
    rel = rel.join(names, F.col("source_id") == F.col("_i")).drop("_i").withColumnRenamed("name", "source_name").join(names, F.col("target_id") == F.col("_i")).drop("_i").withColumnRenamed("name", "target_name")
    lines = context.assemble(ranked, rel, r.max_context_tokens).persist()
    packed = context.block(lines, question).first()
    keys = sorted(x["position"] for x in lines.where("part = 'paragraph'").collect())
    reply = answer((ANSWER_RULES, packed["context_block"]))
    spark = t.paragraphs.sparkSession
    orphans = spark.createDataFrame([(reply["answer"],)], "a string").select(orphan_citations("a", F.array(*map(F.lit, keys)) if keys else F.array().cast("array<int>")).alias("o")).first()["o"]
    for df in (p, e, lines):
        df.unpersist()
    return {"answer": reply["answer"], "citations": reply["citations"], "confident": reply["confident"], "sources": keys, "orphan_citations": orphans, "context": packed["context_block"], "trace": {"context_tokens": packed["context_tokens"], "seconds": time.time() - began}}
