"""A run over a folder: new and changed files are parsed, extracted and embedded, entities are resolved over all that is known,
and a version of the graph is written that holds old and new documents.

A version keeps what model calls gave (extractions, vectors) and everything else is built of it, so no call is made twice.
Documents are named by their content: a file that was moved is the same document.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import chunk_embedding_text, key_id
from quillgraph.operators import graph, ledger, resolution
from quillgraph.operators.sections import ChunkOptions, chunk_documents
from quillgraph.plans import ingest
from quillgraph.plans.answers import GraphTables
from quillgraph.plans.plugins import PluginManager
from quillgraph.schemas import CALLS, MERGES, SENTINEL
from quillgraph.session import kept
from quillgraph.sources import files
from quillgraph.sources.config import Config

#: Tables that the next run starts from.
CARRIED = ("documents", "chunks", "extractions", "vectors", "entity_vectors", "calls", "merges", "sentinel")
VECTORS = "id string, embedding array<float>, embedding_model string"
PRICES = "model string, input_per_million double, output_per_million double"
#: Parts in which the documents of a run are extracted under a budget; what a run spends past it is a part at most.
PARTS = 16


@dataclass
class Models:
    """The model calls of a run; stand-ins by default."""

    extractor: ingest.Extractor = ingest.stub_extractor
    embedder: ingest.Embedder | None = None
    judge: Callable[[Column, Column, Column], Column] | None = None
    embedding_model: str = "stub"
    dims: int = 64

    def embed(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        found = ingest.embed(rows, self.embedder or ingest.stub_embedder(self.dims), self.dims, id_col, text_col)
        return found.withColumn("embedding_model", F.lit(self.embedding_model))


def current(spark: SparkSession, out: str) -> str | None:
    """The last whole version below out."""
    try:
        return spark.read.schema("version string").json(f"{out}/*/_COMPLETE").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def carried(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The CARRIED tables of the last version; none before the first."""
    version = current(spark, out)
    return {name: spark.read.parquet(f"{out}/{version}/{name}") for name in CARRIED} if version else {}


def _added(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def _extracted(chunks: DataFrame, models: Models, prices: DataFrame, budget: float | None) -> tuple[DataFrame, DataFrame]:
    """(extractions, documents that were extracted). Under a budget documents go part by part, and none follow once the cost
    has reached it; the rest is left for another run."""
    if budget is None:
        return kept(ingest.extract(chunks, models.extractor)), chunks.select("doc_id").distinct()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    done, spent, n = None, 0.0, 0
    while n < PARTS and spent < budget:
        found = kept(ingest.extract(chunks.where(part == n), models.extractor))
        spent += ledger.priced(found, prices).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]
        done, n = _added(done, found), n + 1
    if done is None:
        done = kept(ingest.extract(chunks.limit(0), models.extractor))
    return done, chunks.where(part < n).select("doc_id").distinct()


def _calls(extractions: DataFrame, chunks: DataFrame, texts: DataFrame, models: Models, prices: DataFrame, now: int) -> DataFrame:
    """schemas.CALLS of a run: an extraction and an embedding for each chunk."""
    made = extractions.join(chunks.select("chunk_id", F.col("doc_id").alias("document_id")), "chunk_id").select(F.lit("extraction").alias("call_type"), "model", "document_id", "chunk_id", "input_tokens", "output_tokens")
    embedded = texts.select(F.lit("embedding").alias("call_type"), F.lit(models.embedding_model).alias("model"), F.col("doc_id").alias("document_id"), "chunk_id", F.ceil(F.length("text") / 4).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    out = ledger.priced(made.unionByName(embedded), prices).withColumn("at", F.lit(now).cast("long"))
    return out.select(*(x.split()[0] for x in CALLS.split(", ")))


def _merged(entities: DataFrame, rows: dict[str, DataFrame], mapping: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Entities after a mapping, and mentions and relationships that point to what is left of them."""
    m = mapping.select(F.col("merged_id").alias("_m"), F.col("canonical_id").alias("_c"))
    mentions = rows["mentions"].join(m, F.col("entity_id") == F.col("_m"), "left").select(F.coalesce("_c", "entity_id").alias("entity_id"), "chunk_id", "paragraph_id", "context").dropDuplicates(["entity_id", "chunk_id"])
    edges = resolution.redirect(rows["relationships"].withColumn("_o", F.struct("source_id", "target_id")), mapping, "_o")
    return resolution.absorb(entities, mapping), rows | {"mentions": mentions, "relationships": edges}


def resolve(rows: dict[str, DataFrame], models: Models, config: Config = Config(), vectors: DataFrame | None = None, merges: DataFrame | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
    """rows with entities, mentions and relationships after merging, `merges` and `entity_vectors`.

    First the merges of earlier runs and entities of equal normalized names, then pairs of similar vectors that the judge
    calls the same; all pairs that were judged are logged. Entities without a vector of the model get one, and so do
    canonicals that took something in for the first time, as their contexts have changed. dry_run: log, but merge nothing."""
    spark, own = rows["entities"].sparkSession, rows["entities"]
    known = own.join(rows["documents"].select("document_id", "processed_at"), "document_id")
    entities = known.groupBy("id", "name", "type", "normalized_name").agg(F.min("processed_at").alias("first_seen"))
    aliases = own.select("id", F.explode("aliases").alias("alias")).distinct().groupBy("id").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    entities = kept(entities.join(aliases, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).join(rows["mention_counts"].withColumnRenamed("entity_id", "id"), "id"))
    vectors = spark.createDataFrame([], VECTORS) if vectors is None else vectors
    merges = spark.createDataFrame([], MERGES) if merges is None else merges
    if not config.resolution.enabled:
        return rows | {"entities": entities.drop("normalized_name"), "merges": merges, "entity_vectors": vectors}

    skip = config.resolution.skip_types
    there = entities.select("id")
    before = merges.where("applied").join(there.withColumnRenamed("id", "merged_id"), "merged_id", "left_semi").join(there.withColumnRenamed("id", "canonical_id"), "canonical_id", "left_semi")
    equal = kept(resolution.exact_merges(entities, skip).join(before.select("merged_id", "canonical_id"), ["merged_id", "canonical_id"], "left_anti"))
    nothing = equal.limit(0).select("merged_id", "canonical_id")
    first = nothing if dry_run else kept(resolution.canonicals(entities, before.select(F.col("merged_id").alias("a"), F.col("canonical_id").alias("b")).unionByName(equal.select(F.col("merged_id").alias("a"), F.col("canonical_id").alias("b")))))
    entities, rows = _merged(entities, rows, first)
    entities = kept(entities)

    def embedded(due: DataFrame, mentions: DataFrame, old: DataFrame) -> DataFrame:
        texts = resolution.embedding_texts(due.join(old, "id", "left"), mentions, models.embedding_model)
        return kept(graph.upsert_vectors(old, models.embed(texts, "id", "text")))

    vectors = embedded(entities, rows["mentions"], vectors)
    pairs = resolution.candidate_pairs(entities.join(vectors.select("id", "embedding"), "id"), config.resolution.similarity_threshold, config.resolution.max_candidates, skip, blocked_dims=models.dims)
    decided = kept(resolution.judged(pairs, entities, models.judge or resolution.token_overlap_judge()))
    second = nothing if dry_run else kept(resolution.canonicals(entities, decided.where("decision = 'same'").select("a", "b")))
    entities, rows = _merged(entities, rows, second)
    took = first.join(before.select("merged_id"), "merged_id", "left_anti").unionByName(second).select(F.col("canonical_id").alias("id")).distinct()
    entities = kept(entities)
    # Without their old vector, canonicals that took something in are due again.
    changed = entities.join(took, "id", "left_semi")
    again = resolution.embedding_texts(changed.withColumn("embedding", F.lit(None)).withColumn("embedding_model", F.lit(None).cast("string")), rows["mentions"], models.embedding_model)
    vectors = kept(graph.upsert_vectors(vectors, models.embed(again, "id", "text")))

    listed = lambda df, a, b, score, decision, applied: df.select(F.col(a).alias("merged_id"), F.col(b).alias("canonical_id"), score.cast("double").alias("similarity"), decision.alias("decision"), applied.alias("applied"))
    log = resolution.merge_log(decided, second, dry_run)
    new = listed(equal, "merged_id", "canonical_id", F.lit(None), F.lit("same"), F.lit(not dry_run)).unionByName(listed(log, "a", "b", F.col("similarity"), F.col("decision"), F.col("applied")))
    return rows | {"entities": entities, "merges": merges.unionByName(new.join(merges.select("merged_id", "canonical_id").distinct(), ["merged_id", "canonical_id"], "left_anti")), "entity_vectors": vectors}


def run(spark: SparkSession, folder: str, out: str, config: Config = Config(), plugins: PluginManager | None = None, models: Models = Models(), prices: DataFrame | None = None) -> str:
    """Writes the next version below out and returns its path.

    Files whose content is known are skipped, unparsable ones are rows of `errors` and tried again by the next run. Documents
    whose file below `folder` is gone or has other content leave with all that was built of them; those of other folders
    stay. All hooks run: the first three on rows that the graph is built of, the last three when the version is written."""
    plugins, now = plugins or PluginManager(), time.time_ns() // 1_000_000
    prices = spark.createDataFrame([], PRICES) if prices is None else prices
    old = carried(spark, out)
    if old:
        graph.check_schema_sentinel(old["sentinel"], models.embedding_model, models.dims, models.dims)
    good, _ = files.classify(files.discover(spark, folder))
    listing = kept(good.drop("content"))
    todo = plugins.run("files_discovered", listing)
    rest = [c for c in todo.columns if c != "content_hash"]
    todo = todo.groupBy("content_hash").agg(F.min_by(F.struct(*rest), "path").alias("_r")).select("content_hash", "_r.*")
    if old:
        todo = todo.join(old["documents"].select("content_hash"), "content_hash", "left_anti")
    todo = kept(todo)

    parsed = kept(files.parse(good.select("path", "file_type", "content").join(todo.select("path"), "path", "left_semi")))
    docs = plugins.run("documents_parsed", todo.join(parsed.where("error is null").select("path", "title", "author", "page_count", "word_count"), "path"))
    if "properties" not in docs.columns:
        docs = docs.withColumn("properties", F.create_map().cast("map<string,string>"))
    docs = kept(docs.withColumn("document_id", key_id("content_hash")).withColumn("processed_at", F.lit(now).cast("long")))
    c = config.chunker
    options = ChunkOptions(c.target_tokens, c.overlap_tokens, c.min_chunk_tokens, c.max_chunk_tokens)
    chunks = kept(chunk_documents(files.sections(parsed.join(docs.select("path", "document_id"), "path"), "document_id"), options))
    extractions, reached = _extracted(chunks, models, prices, config.cost.budget_per_run)
    # A document without a chunk needs no call and is done; of the others, those whose part was reached.
    waiting = chunks.select("doc_id").distinct().join(reached, "doc_id", "left_anti").withColumnRenamed("doc_id", "document_id")
    docs, chunks = docs.join(waiting, "document_id", "left_anti"), chunks.join(reached, "doc_id", "left_semi")
    texts = chunks.select("doc_id", "chunk_id", chunk_embedding_text(F.col("heading_path"), F.col("content")).alias("text"))
    vectors = kept(models.embed(texts, "chunk_id", "text"))
    calls = kept(_calls(extractions, chunks, texts, models, prices, now))

    gone = None
    if old:
        below = F.startswith("path", F.lit(folder.split(":", 1)[-1].rstrip("/") + "/"))
        gone = kept(old["documents"].where(below).join(listing.select("content_hash"), "content_hash", "left_anti"))
        left = lambda name, key: old[name].join(gone.select(F.col("document_id").alias(key)), key, "left_anti")
        docs, chunks = _added(left("documents", "document_id"), docs), _added(left("chunks", "doc_id"), chunks)
        ours = chunks.select("chunk_id")
        extractions = _added(old["extractions"].join(ours, "chunk_id", "left_semi"), extractions)
        vectors = _added(old["vectors"].join(ours.withColumnRenamed("chunk_id", "id"), "id", "left_semi"), vectors)
    rows = graph.document_rows(docs, chunks, extractions, lambda pair: plugins.run("entities_extracted", pair))
    rows = resolve(rows, models, config, old.get("entity_vectors"), old.get("merges"))
    sentinel = spark.createDataFrame([(models.embedding_model, models.dims, models.dims, now)], SENTINEL)
    rows |= {"chunks": chunks, "extractions": extractions, "vectors": vectors, "calls": _added(old.get("calls"), calls), "sentinel": sentinel, "errors": parsed.where("error is not null").select("path", "error")}
    rows["statistics"] = graph.run_statistics(extractions, rows["entities"], rows["relationships"])
    at = graph.write_graph(rows, out, f"v{time.time_ns()}")
    plugins.run("documents_completed", spark.read.parquet(f"{at}/documents").where(F.col("processed_at") == now))
    if gone is not None:
        plugins.run("documents_removed", gone)
    plugins.run("run_completed", calls)
    return at


def graph_tables(spark: SparkSession, at: str) -> GraphTables:
    """What questions are asked of, of the version at a path."""
    t = lambda name: spark.read.parquet(f"{at}/{name}")
    vectors = t("vectors").select(F.col("id").alias("chunk_id"), "embedding")
    paragraphs = t("paragraphs").join(t("documents").select("document_id", F.col("relative_path").alias("file_name")), "document_id").join(vectors, "chunk_id", "left")
    entities = t("entities").join(t("entity_vectors").select("id", "embedding"), "id", "left")
    edges = t("relationships").select(key_id("source_id", "type", "target_id").alias("edge_id"), F.col("type").alias("kind"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "evidence", "confidence")
    return GraphTables(
        paragraphs.select("id", "document_id", "file_name", "page_number", F.col("heading").alias("section_heading"), "sequence_index", "content", F.col("embedding").cast("array<double>").alias("embedding")),
        entities.select("id", "name", "type", F.col("embedding").cast("array<double>").alias("embedding")), t("mentions").select("entity_id", "paragraph_id"), edges,
    )
