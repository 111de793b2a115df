"""Entity resolution: equal normalized names first, then similar vectors that a judge calls the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.text import entity_embedding_text, normalize_entity_name
from quillgraph.operators.graph import ordered_distinct
from quillgraph.operators.retrieval import blocked_pairs, nearest_pairs
from quillgraph.session import kept

SIMILARITY, CANDIDATES = 0.92, 5
#: Types that merging only harms.
SKIP_TYPES = ("Date", "Metric")


def in_document(entities: DataFrame, mentions: DataFrame, document_id: str) -> DataFrame:
    """Entities mentioned in one document."""
    own = mentions.where(F.col("document_id") == document_id)
    return entities.join(own, entities["id"] == own["entity_id"], "left_semi")


def exact_merges(entities: DataFrame, skip_types: tuple[str, ...] = SKIP_TYPES) -> DataFrame:
    """(merged_id, canonical_id): entities of one type whose normalized names are equal and not empty."""
    own = entities.where(~F.col("type").isin(*skip_types) & (F.coalesce("normalized_name", F.lit("")) != ""))
    best = own.groupBy("normalized_name", "type").agg(F.min(F.struct((-F.col("mention_count")).alias("m"), F.col("first_seen").alias("f"), F.col("id").alias("id")))["id"].alias("canonical_id"), F.count("*").alias("n")).where("n > 1")
    return own.join(best, ["normalized_name", "type"]).where("id <> canonical_id").select(F.col("id").alias("merged_id"), "canonical_id")


def candidate_pairs(entities: DataFrame, threshold: float = SIMILARITY, k: int = CANDIDATES, skip_types: tuple[str, ...] = SKIP_TYPES, blocked_dims: int | None = None) -> DataFrame:
    """(a, b, score): pairs of one type at `threshold` or more on the index scale, at most the k best of each row. All pairs
    of a type are compared, or, for large ones, those in a common block of vectors with blocked_dims dimensions."""
    own = entities.where(~F.col("type").isin(*skip_types) & F.col("embedding").isNotNull())
    if blocked_dims:
        pairs = blocked_pairs(own, threshold, blocked_dims)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        best = both.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("_n") <= k)
    else:
        best = nearest_pairs(own, threshold, k)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()


def judged(pairs: DataFrame, entities: DataFrame, judge: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Pairs with decision, `same` or `different`; a judge that fails for a pair (null) means different."""
    e = entities.select("id", "name", "type")
    out = pairs.join(e.select(F.col("id").alias("a"), F.col("name").alias("name_a"), "type"), "a").join(e.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b")
    return out.withColumn("decision", F.coalesce(judge(F.col("name_a"), F.col("name_b"), F.col("type")), F.lit("different")))


def token_overlap_judge(least: float = 0.5) -> Callable[[Column, Column, Column], Column]:
    """A stand-in for a model: same where the normalized names share at least this part of their words."""

    def judge(a: Column, b: Column, kind: Column) -> Column:
        x, y = F.split(normalize_entity_name(a, kind), " "), F.split(normalize_entity_name(b, kind), " ")
        share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        return F.when(share >= least, "same").otherwise("different")

    return judge


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of the pairs (a, b) hangs together with.

    Every round gives each id the least root among its own and its neighbours', and then that root's root, so a chain of
    n takes about log n rounds. Each is checkpointed, so that a lost executor costs no round again; a cluster needs a
    checkpoint folder, a local session is given one."""
    edges = kept(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = kept(edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        near = edges.join(roots.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["id"] == near["a"]).select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = kept(step.join(jump, "root", "left").select("id", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        roots = step.select("id", "root")
        if not step.where("was <> root").limit(1).count():
            return roots


def canonicals(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(merged_id, canonical_id): one canonical per component of accepted pairs."""
    members = components(pairs).join(entities, "id")
    best = members.groupBy("root").agg(F.min(F.struct((-F.col("mention_count")).alias("m"), F.col("first_seen").alias("f"), F.col("id").alias("id")))["id"].alias("canonical_id"))
    return members.join(best, "root").where("id <> canonical_id").select(F.col("id").alias("merged_id"), "canonical_id")


def merge_log(judged_pairs: DataFrame, mapping: DataFrame, dry_run: bool = False) -> DataFrame:
    """Every pair considered, rejected ones too, and whether it was applied."""
    same = (F.col("decision") == "same") & F.lit(not dry_run)
    return judged_pairs.select(F.col("a"), F.col("b"), F.col("score").alias("similarity"), "decision", same.alias("applied"))


def redirect(edges: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """Edges with both ends mapped to their canonical; edges that became equal are one, as in an upsert, with the source
    documents of all where edges have them. Self-loops stay."""
    m = mapping.select(F.col("merged_id").alias("_m"), F.col("canonical_id").alias("_c"))
    out = edges.join(m, F.col("source_id") == F.col("_m"), "left").withColumn("source_id", F.coalesce("_c", "source_id")).drop("_m", "_c")
    out = out.join(m, F.col("target_id") == F.col("_m"), "left").withColumn("target_id", F.coalesce("_c", "target_id")).drop("_m", "_c")
    listed = [ordered_distinct(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(c).alias("items")))).alias(c) for c in ("evidence", "source_documents") if c in edges.columns]
    return out.groupBy("source_id", "type", "target_id").agg(*listed, F.max("confidence").alias("confidence"))


def absorb(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities after merging: aliases of the canonical, then names and aliases of the merged ones, without repeats and
    without its own name; mention counts summed; the earliest first_seen."""
    e = entities.join(mapping.withColumnRenamed("merged_id", "id"), "id", "left")
    is_merged = F.col("canonical_id").isNotNull()
    e = e.withColumn("_key", F.coalesce("canonical_id", "id"))
    names = F.when(is_merged, F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).otherwise(F.coalesce("aliases", F.array().cast("array<string>")))
    items = F.struct(F.struct(is_merged.cast("int").alias("m"), F.col("id").alias("i")).alias("ord"), names.alias("items"))
    own = lambda c: F.max(F.when(~is_merged, F.col(c)))
    out = e.groupBy("_key").agg(own("name").alias("name"), own("type").alias("type"), ordered_distinct(F.collect_list(items)).alias("aliases"), F.sum("mention_count").alias("mention_count"), F.min("first_seen").alias("first_seen"))
    return out.withColumn("aliases", F.filter("aliases", lambda a: a != F.col("name"))).withColumnRenamed("_key", "id")


def embedding_texts(entities: DataFrame, contexts: DataFrame, model: str, most: int = 5) -> DataFrame:
    """(id, text) of entities without a vector of `model`, with up to `most` distinct contexts, sorted."""
    due = entities.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))
    own = contexts.groupBy("entity_id").agg(F.slice(F.array_sort(F.collect_set("context")), 1, most).alias("contexts"))
    out = due.join(own, due["id"] == own["entity_id"], "left")
    return out.select("id", entity_embedding_text(F.col("name"), F.col("type"), F.coalesce("contexts", F.array().cast("array<string>"))).alias("text"))
