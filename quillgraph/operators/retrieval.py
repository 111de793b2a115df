"""Vector lookups, graph expansion, ranking and hybrid search over node and edge tables.

Anchors are small by contract (at most 100) and are broadcast only where a limit above them bounds their number.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.vector import cosine, dot, index_score, literal
from quillgraph.operators import pairs
from quillgraph.session import kept

#: Score of rows that come from the graph and not from the index.
EXPANSION_SCORE = 0.4
MAX_HOPS = 4
#: Rows that are broadcast; more are joined by a shuffle.
FEW = 100_000


@dataclass(frozen=True)
class Filters:
    """Conditions on anchors; None asks for nothing."""

    equal: dict[str, object] | None = None
    among: dict[str, list] | None = None
    min_score: float | None = None

    def on_rows(self) -> Column:
        out = F.lit(True)
        for k, v in (self.equal or {}).items():
            out = out & (F.col(k) == F.lit(v))
        for k, v in (self.among or {}).items():
            out = out & F.col(k).isin(v)
        return out

    def on_score(self) -> Column:
        return F.lit(True) if self.min_score is None else F.col("score") >= self.min_score


def top_k(vectors: DataFrame, query: list[float], k: int, filters: Filters = Filters(), mode: str = "pre", vector_col: str = "embedding", id_col: str = "id", normalized: bool = True) -> DataFrame:
    """The k rows nearest to `query` by cosine, with `score`; ties go to the smaller id.

    mode "pre" filters before the limit, so k rows return if there are k; "post" filters what the index returned.
    Vectors that are null or zero are not in the index. The limit is taken per partition first: nothing is sorted whole.
    """
    cos = cosine(F.col(vector_col), literal(query))
    rows = vectors.withColumn("score", index_score(cos) if normalized else cos).where(F.col("score").isNotNull())
    if mode == "pre":
        rows = rows.where(filters.on_rows() & filters.on_score())
    rows = rows.orderBy(F.desc("score"), id_col).limit(k)
    if mode == "post":
        rows = rows.where(filters.on_rows() & filters.on_score())
    return rows.drop(vector_col)


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "id", type_col: str = "type", vector_col: str = "embedding", normalized: bool = True) -> DataFrame:
    """(a, b, score) for rows of one type whose score reaches `threshold`, a < b. Exact, so work grows with the square of
    a type; a type is dealt to blocks, each two of which meet in a group of their own."""
    return pairs.all_pairs(vectors, pairs.Measure(threshold, normalized), id_col, type_col, vector_col)


def similar_links(vectors: DataFrame, threshold: float, id_col: str = "id", type_col: str = "type", vector_col: str = "embedding", normalized: bool = True) -> DataFrame:
    """(a, b) with the components of similar_pairs, without listing all of its pairs."""
    return pairs.links(vectors, pairs.Measure(threshold, normalized), id_col, type_col, vector_col)


def nearest_pairs(vectors: DataFrame, threshold: float, k: int, id_col: str = "id", type_col: str = "type", vector_col: str = "embedding", normalized: bool = True) -> DataFrame:
    """(a, b, score): of the pairs of similar_pairs, both ways round, the k best of each a; ties go to the smaller b."""
    near = pairs.nearest(vectors, pairs.Measure(threshold, normalized), k, id_col, type_col, vector_col)
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("_n") <= k).drop("_n")


def blocked_pairs(vectors: DataFrame, threshold: float, dims: int, tables: int = 12, bits: int = 6, seed: int = 7, id_col: str = "id", type_col: str = "type", vector_col: str = "embedding", normalized: bool = True) -> DataFrame:
    """similar_pairs among rows that share the signs of `bits` random projections in one of `tables` tables: work grows with
    the size of these blocks and not with the square of a type. It finds a pair at angle a with probability
    1 - (1 - (1 - a / pi) ** bits) ** tables, and nothing that isn't a pair."""
    rng = random.Random(seed)
    planes = [[[rng.gauss(0, 1) for _ in range(dims)] for _ in range(bits)] for _ in range(tables)]
    side = lambda plane: F.when(dot(F.col(vector_col), literal(plane)) >= 0, "1").otherwise("0")
    signs = F.array(*(F.concat(F.lit(f"{n}:"), *map(side, table)) for n, table in enumerate(planes)))
    own = vectors.select(F.col(id_col).alias("a"), F.col(type_col).alias("t"), F.explode(signs).alias("block"))
    other = own.select(F.col("a").alias("b"), "t", "block")
    near = own.join(other, ["t", "block"]).where("a < b").select("a", "b").distinct()
    v = vectors.select(F.col(id_col).alias("_i"), F.col(vector_col).alias("_v"))
    near = near.join(v, F.col("a") == F.col("_i")).select("a", "b", F.col("_v").alias("va")).join(v, F.col("b") == F.col("_i")).select("a", "b", "va", F.col("_v").alias("vb"))
    cos = cosine(F.col("va"), F.col("vb"))
    return near.select("a", "b", (index_score(cos) if normalized else cos).alias("score")).where(F.col("score") >= threshold)


def layout_expand(anchors: DataFrame, paragraphs: DataFrame, window: int, doc_col: str = "document_id", seq_col: str = "sequence_index") -> DataFrame:
    """Paragraphs at most `window` places from an anchor of the same document, the anchor itself too, each once. The band
    becomes an equi-join by listing the places around each anchor."""
    places = anchors.select(doc_col, F.explode(F.sequence(F.col(seq_col) - window, F.col(seq_col) + window)).alias(seq_col)).distinct()
    return paragraphs.join(places, [doc_col, seq_col], "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(edge_id, kind, src, dst, s, t): each edge once in each direction; s and t keep its own."""
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    own = edges.select("edge_id", "kind", F.col("src").alias("s"), F.col("dst").alias("t"), F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("_w"))
    return own.select("edge_id", "kind", "_w.src", "_w.dst", "s", "t")


def _few(rows: DataFrame) -> DataFrame:
    """The distinct rows, computed once, and broadcast if they are few, so that what they meet isn't shuffled."""
    rows = kept(rows.distinct())
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def trails(anchors: DataFrame, edges: DataFrame, hops: int, front_of: Callable[[DataFrame], DataFrame] = lambda front: front) -> DataFrame:
    """(anchor, node, path) for every undirected trail of 1 to `hops` edges: edges once, nodes as often as they come.

    hops is clamped to 1..4. Each hop is a join of the frontier, as front_of gives it, to the symmetric edges on the node."""
    hops = max(1, min(MAX_HOPS, hops))
    step = both_ways(edges).select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.struct("edge_id", "kind", "s", "t").alias("_e"))
    front = anchors.select(F.col("id").alias("anchor"), F.col("id").alias("node"), F.array().cast(f"array<{step.schema['_e'].dataType.simpleString()}>").alias("path"))
    found = None
    for _ in range(hops):
        front = front_of(front).join(step, F.col("node") == F.col("_at")).where(~F.exists("path", lambda x: x["edge_id"] == F.col("_e.edge_id")))
        front = front.select("anchor", F.col("_to").alias("node"), F.concat("path", F.array("_e")).alias("path"))
        found = front if found is None else found.unionByName(front)
    return found


def semantic_expand(anchors: DataFrame, edges: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Neighbours (id) within `hops` of the anchors, and the edges (s, kind, t) on the way, each once."""
    found = trails(anchors, edges, hops)
    neighbours = found.select(F.col("node").alias("id")).distinct()
    passed = found.select(F.explode("path").alias("e")).select("e.s", "e.kind", "e.t").distinct()
    return neighbours, passed


def cross_expand(anchors: DataFrame, mentions: DataFrame, edges: DataFrame, paragraphs: DataFrame, hops: int = 2, limit: int = 5) -> DataFrame:
    """From anchor paragraphs over the entities they mention to neighbours, and from these to their paragraphs: for each
    anchor and neighbour the first `limit` by place, each paragraph once. The starting entity is no neighbour of itself,
    nor the anchor a result of its own. Repeated mentions count once before the limit, and repeated edges as one.

    Each step goes from the rows reached so far, which are computed at once, to the tables, so that these are shuffled only
    where more than FEW rows meet them; the paragraphs are, by id and place."""
    m = mentions.select(F.col("entity_id").alias("_e"), F.col("paragraph_id").alias("_p"))
    start = _few(_few(anchors.select(F.col("id").alias("_a"))).join(m, F.col("_a") == F.col("_p")).select("_a", F.col("_e").alias("_from")))
    reach = trails(start.select(F.col("_from").alias("id")), edges, hops, _few).where("anchor <> node").select(F.col("anchor").alias("_from"), "node").distinct()
    near = _few(start.join(reach, "_from").select("_a", "node"))
    place = paragraphs.select(F.col("id").alias("_p"), F.col("sequence_index").alias("_s"))
    hit = m.join(near, F.col("node") == F.col("_e")).where("_p <> _a").select("_a", "node", "_p").distinct().join(place, "_p")
    first = Window.partitionBy("_a", "node").orderBy("_s", "_p")
    return hit.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).select(F.col("_p").alias("id")).distinct()


def paragraph_mentions(ids: DataFrame, mentions: DataFrame) -> DataFrame:
    """(paragraph_id, entity_ids): the distinct entities of each paragraph in `ids`, sorted."""
    own = mentions.join(ids.select(F.col("id").alias("paragraph_id")), "paragraph_id", "left_semi")
    return own.groupBy("paragraph_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))


def hydrate(ids: DataFrame, paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """Paragraphs by id with the name of their document."""
    named = documents.select("document_id", F.coalesce("file_name", "file_path", F.lit("")).alias("file_name"))
    return paragraphs.join(ids.select("id"), "id", "left_semi").join(named, "document_id")


def merge_first(*frames: DataFrame, key: str = "id", score: str = "vector_score") -> DataFrame:
    """Union in which a key keeps its first row, but the highest score of all."""
    all_ = None
    for n, f in enumerate(frames):
        f = f.withColumn("_ord", F.lit(n))
        all_ = f if all_ is None else all_.unionByName(f, allowMissingColumns=True)
    rest = [c for c in all_.columns if c not in (key, score)]
    out = all_.groupBy(key).agg(F.max(score).alias(score), F.min_by(F.struct(*rest), F.struct("_ord", *(c for c in rest if c != "_ord"))).alias("_r"))
    return out.select(key, score, *(F.col(f"_r.{c}").alias(c) for c in rest if c != "_ord"))


def hybrid_order(anchors: DataFrame, expanded: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Anchors with their score, and expanded rows that are no anchors with a fixed one; origin tells which."""
    keys = [key] if isinstance(key, str) else key
    own = anchors.select(*keys, F.col("score"), F.lit("vector").alias("origin"))
    more = expanded.join(own.select(*keys), keys, "left_anti").select(*keys, F.lit(EXPANSION_SCORE).alias("score"), F.lit("expansion").alias("origin"))
    return own.unionByName(more)


def rank_paragraphs(paragraphs: DataFrame, anchor_entities: DataFrame, mentions: DataFrame, alpha: float, order_col: str = "ord") -> DataFrame:
    """alpha * vector_score + (1 - alpha) * share of the anchor entities that the paragraph mentions, as combined; a
    paragraph that comes twice keeps its first place in order_col. Sort by combined descending, then order_col."""
    n = anchor_entities.select("id").distinct().agg(F.greatest(F.lit(1), F.count("*")).alias("_anchors"))
    once = paragraphs.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order_col))).where("_n = 1").drop("_n")
    hits = mentions.join(anchor_entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    hits = hits.select(F.col("paragraph_id").alias("id"), "entity_id").distinct().groupBy("id").agg(F.count("*").alias("matches"))
    out = once.join(hits, "id", "left").crossJoin(F.broadcast(n))  # one row
    out = out.withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("combined", alpha * F.coalesce("vector_score", F.lit(0.0)) + (1 - alpha) * F.col("matches") / F.col("_anchors")).drop("_anchors")
