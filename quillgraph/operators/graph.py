"""Building the layout and semantic graph, and merging rows into it by key.

Parquet has no MERGE, so an upsert is one aggregation over old and new rows: old ones first, by `_old`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.text import key_id, normalize_entity_name, relationship_type

CONTEXT_CHARS = 240


def next_edges(rows: DataFrame, group: str, order: str, id_col: str) -> DataFrame:
    """(src, dst) between neighbours in reading order."""
    w = Window.partitionBy(group).orderBy(order, id_col)
    return rows.select(F.col(id_col).alias("src"), F.lead(id_col).over(w).alias("dst")).where(F.col("dst").isNotNull())


def first_appearance(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(group, key, sequence_index): keys of a group numbered from 0 as they first come."""
    first = rows.groupBy(group, key).agg(F.min(order).alias("_first"))
    return first.withColumn("sequence_index", F.row_number().over(Window.partitionBy(group).orderBy("_first", key)) - 1).drop("_first")


def ordered_distinct(lists: Column) -> Column:
    """Elements of an array of (order, array) structs, in order, each the first time that it comes."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(lists), lambda x: x["items"])))


def dedupe_entities(entities: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: aliases appended unseen in order, the highest confidence, the first properties."""
    items = F.struct(F.col(order).alias("ord"), F.coalesce("aliases", F.array().cast("array<string>")).alias("items"))
    return entities.groupBy(*keys).agg(ordered_distinct(F.collect_list(items)).alias("aliases"), F.max("confidence").alias("confidence"), F.min_by("properties", order).alias("properties"))


def upsert_entities(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """(name, type, normalized_name, aliases, confidence, properties, first_seen, last_seen, mention_count) after merging
    `new` (one row per name and type): new aliases that the old row lacks stand before its own, confidence is the higher,
    the old row's other values stay, last_seen is `now`."""
    n = new.select("name", "type", F.col("aliases").alias("_na"), F.col("confidence").alias("_nc"), F.col("properties").alias("_np"), F.col("normalized_name").alias("_nn"))
    out = old.join(n, ["name", "type"], "full_outer")
    none = F.array().cast("array<string>")
    oa, na = F.coalesce("aliases", none), F.coalesce("_na", none)
    fresh = F.filter(na, lambda x: ~F.array_contains(oa, x))
    return out.select(
        "name", "type", F.coalesce("normalized_name", "_nn").alias("normalized_name"), F.concat(fresh, oa).alias("aliases"), F.greatest("confidence", "_nc").alias("confidence"), F.coalesce("properties", "_np").alias("properties"),
        F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(F.col("_nc").isNotNull(), F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
    )


def upsert_relationships(rows: DataFrame, order: str) -> DataFrame:
    """One edge per (source_id, type, target_id): evidence and source documents appended unseen in order, the highest
    confidence, the first properties. Old and new rows go in together, `order` putting the old ones first."""
    listed = lambda c: ordered_distinct(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(c).alias("items"))))
    return rows.groupBy("source_id", "type", "target_id").agg(listed("evidence").alias("evidence"), listed("source_documents").alias("source_documents"), F.max("confidence").alias("confidence"), F.min_by("properties", order).alias("properties"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there yet; of equal new ones, one."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def merge_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by content_hash: an old one keeps all but processed_at, which becomes the later."""
    both = old.withColumn("_old", F.lit(0)).unionByName(new.withColumn("_old", F.lit(1)))
    rest = [c for c in old.columns if c not in ("content_hash", "processed_at")]
    out = both.groupBy("content_hash").agg(F.max("processed_at").alias("processed_at"), F.min_by(F.struct(*rest), F.struct("_old", *rest)).alias("_r"))
    return out.select("content_hash", "processed_at", *(F.col(f"_r.{c}").alias(c) for c in rest))


def merge_properties(old: DataFrame, new: DataFrame, key: str, props: str = "properties") -> DataFrame:
    """Rows by key; a new row's properties are laid over the old one's."""
    both = old.join(new.select(F.col(key).alias("_k"), F.col(props).alias("_p")), F.col(key) == F.col("_k"), "full_outer")
    none = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(props, none), F.coalesce("_p", none)
    return both.select(F.coalesce(key, "_k").alias(key), F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n).alias(props))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids in `gone` and all that touches them."""
    ids = gone.select(F.col("id").alias("_g"))
    return nodes.join(ids, F.col("id") == F.col("_g"), "left_anti"), edges.join(ids, F.col("src") == F.col("_g"), "left_anti").join(ids, F.col("dst") == F.col("_g"), "left_anti")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row written of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*(c for c in log.columns if c != key)), order).alias("_r")).select(key, "_r.*")


def mark_failed(log: DataFrame, failures: DataFrame) -> DataFrame:
    """Failure rows (file_path, error_message, processed_at, seq) as log rows that keep the hash and document known."""
    known = latest(log, "file_path", "seq").select("file_path", "content_hash", "document_id")
    return failures.join(known, "file_path", "left").withColumn("status", F.lit("failed")).withColumn("cost_usd", F.lit(None).cast("double"))


def resolve_endpoints(relationships: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relationships (chunk_id, source, relationship, target ...) with the types of their ends, looked up among the
    entities of the same chunk, the first of each name; and those that miss an end."""
    first = entities.groupBy("chunk_id", "name").agg(F.min_by("type", "ord").alias("type"))
    s = first.select("chunk_id", F.col("name").alias("source"), F.col("type").alias("source_type"))
    t = first.select("chunk_id", F.col("name").alias("target"), F.col("type").alias("target_type"))
    both = relationships.join(s, ["chunk_id", "source"], "left").join(t, ["chunk_id", "target"], "left")
    whole = F.col("source_type").isNotNull() & F.col("target_type").isNotNull()
    return both.where(whole).withColumn("type", relationship_type("relationship")), both.where(~whole)


def mention_edges(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (entity_id, chunk_id, paragraph_id, context), one per key, and (entity_id, mention_count) counted on all rows."""
    edges = mentions.groupBy("entity_id", "chunk_id", "paragraph_id").agg(F.substring(F.min("content"), 1, CONTEXT_CHARS).alias("context"))
    return edges, mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count"))


def document_rows(doc: DataFrame, chunks: DataFrame, extractions: DataFrame, filtered: Callable[[tuple[DataFrame, DataFrame]], tuple[DataFrame, DataFrame]] = lambda pair: pair) -> dict[str, DataFrame]:
    """All node and edge rows of the documents in `doc` (document_id ...): pages, sections, paragraphs, reading order,
    entities, relationships and mentions. Every id is a hash of its key, so a second run gives the same rows.

    filtered: what becomes of the extracted (entities, relationships) before anything is built of them."""
    page = F.coalesce(F.get("pages", F.lit(0)), F.lit(1))
    heading = F.coalesce("section_title", F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    own = chunks.select("chunk_id", F.col("doc_id").alias("document_id"), F.col("seq").alias("sequence_index"), "content", "tokens", page.alias("page_number"), heading.alias("heading"), F.size("heading_path").alias("heading_level"))
    pages = own.select("document_id", "page_number").distinct().withColumn("id", key_id("document_id", "page_number"))
    sections = own.groupBy("document_id", "page_number", "heading").agg(F.min("sequence_index").alias("_first"), F.max("heading_level").alias("heading_level"))
    sections = sections.withColumn("sequence_index", F.row_number().over(Window.partitionBy("document_id").orderBy("_first")) - 1).drop("_first").withColumn("id", key_id("document_id", "page_number", "heading"))
    paragraphs = own.withColumn("id", key_id("document_id", "chunk_id")).withColumn("section_id", key_id("document_id", "page_number", "heading"))
    ents = extractions.select("chunk_id", F.posexplode("entities").alias("ord", "e")).select("chunk_id", "ord", "e.*")
    rels = extractions.select("chunk_id", F.posexplode("relationships").alias("ord", "r")).select("chunk_id", "ord", "r.*")
    ents, rels = filtered((ents, rels))
    placed = ents.join(own.select("chunk_id", "document_id", "sequence_index", "content"), "chunk_id").withColumn("_o", F.struct("sequence_index", "ord"))
    entities = dedupe_entities(placed, ["document_id", "name", "type"], "_o").withColumn("normalized_name", normalize_entity_name("name", "type")).withColumn("id", key_id("name", "type"))
    found, lost = resolve_endpoints(rels, ents)
    found = found.join(own.select("chunk_id", "document_id", "sequence_index"), "chunk_id")
    found = found.select(key_id("source", "source_type").alias("source_id"), "type", key_id("target", "target_type").alias("target_id"), F.when(F.col("evidence") != "", F.array("evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"), F.array("document_id").alias("source_documents"), "confidence", "properties", F.struct("document_id", "sequence_index", "ord").alias("_o"))
    mentions = placed.select(key_id("name", "type").alias("entity_id"), "chunk_id", key_id("document_id", "chunk_id").alias("paragraph_id"), "content")
    edges, counts = mention_edges(mentions)
    return {
        "documents": doc, "pages": pages, "sections": sections, "paragraphs": paragraphs, "page_order": next_edges(pages, "document_id", "page_number", "id"), "paragraph_order": next_edges(paragraphs, "document_id", "sequence_index", "id"),
        "entities": entities, "relationships": upsert_relationships(found, "_o"), "lost_relationships": lost, "mentions": edges, "mention_counts": counts,
    }


def write_graph(rows: dict[str, DataFrame], root: str, version: str) -> str:
    """Writes each table below root/version, then a marker; readers take a version only with its marker, so that they see
    all of it or nothing."""
    for name, df in rows.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark = next(iter(rows.values())).sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/{version}/_COMPLETE")
    return f"{root}/{version}"


def check_schema_sentinel(sentinel: DataFrame, model: str, paragraph_dims: int, entity_dims: int) -> None:
    """Raises where vectors were written by another model or in other dimensions."""
    row = sentinel.orderBy(F.desc("applied_at")).first()
    if row and (row["embedding_model"], row["paragraph_dims"], row["entity_dims"]) != (model, paragraph_dims, entity_dims):
        raise ValueError(f"the graph holds vectors of {row['embedding_model']} ({row['paragraph_dims']}, {row['entity_dims']}), not of {model} ({paragraph_dims}, {entity_dims})")


def run_statistics(extractions: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: chunks, and entities and relationships as extracted, repeats counted, beside those that were written."""
    size = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0)).alias(c)
    extracted = extractions.agg(F.count("*").alias("chunks"), size("entities"), size("relationships"))
    written = lambda df, name: df.agg(F.count("*").alias(name))
    return extracted.join(written(entities, "entities_written")).join(written(relationships, "relationships_written"))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (id, embedding, embedding_model) by id: a new row replaces the old one, whose model stays if none is given."""
    n = new.select(F.col("id").alias("_i"), F.col("embedding").alias("_v"), F.col("embedding_model").alias("_m"))
    out = old.join(n, F.col("id") == F.col("_i"), "full_outer")
    return out.select(F.coalesce("_i", "id").alias("id"), F.coalesce("_v", "embedding").alias("embedding"), F.coalesce("_m", "embedding_model").alias("embedding_model"))


def delete_by_id(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("id"), "id", "left_anti")
