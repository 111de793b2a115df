"""A training corpus from raw documents: language, near duplicates, benchmark passages, personal data, source mix.

Each stage takes the documents that the one before kept and returns those that it keeps, with the columns of `documents`;
the last returns the mix: every document left and how many of its words are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, langid, mixing, near_dup, pii
from quillgraph.llm.store import stored, without_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those without a letter, or not typical enough of any learned language, go. Where nothing
    could be learned (no labelled text), only documents without a letter go. Repeated rows and null ids are judged like
    any other."""
    model = langid.learn(docs)
    found = langid.predict(docs, model, keep=COLUMNS)
    if model is None:
        return docs.select(*COLUMNS).where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return found.where((F.col("lang_pred") != "und") & F.col("known")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates, and one row of each id and text, the
    least by its other columns. Where texts differ under one id, each is a document, named by id and text, and they go
    only as near duplicates. Documents with a null id can't be named in a class and stay."""
    docs = docs.select(*COLUMNS)
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(_text_key()).alias("least"), F.max(_text_key()).alias("most")).where("n > 1")
    if not again.limit(1).count():
        classes = near_dup.near_duplicates(docs)
        return without_ids(docs, classes.where(F.col("class_id") < F.col("doc_id")).select("doc_id"), "doc_id")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    named = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest")).select("doc_id", "text", "_rest.*")
    ids = "doc_id"
    if again.where("least <> most").limit(1).count():
        ids, named = "_id", named.withColumn("_id", F.struct("doc_id", _text_key().alias("key")))
    classes = near_dup.near_duplicates(named, doc_col=ids)
    left = without_ids(named, classes.where(F.col("class_id") < F.col(ids)).select(ids), ids).select(*COLUMNS)
    return left.unionByName(docs.where(F.col("doc_id").isNull()))


def _text_key() -> Column:
    """Names a text; null has a name of its own."""
    return F.coalesce(F.sha2("text", 256), F.lit(""))


#: Words of a passage that the corpus and the benchmark may not have in common.
PASSAGE = 13


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have no passage of PASSAGE words in common with the benchmark, however long they are, and of
    which less than a twentieth of the words lie in shorter items. Each row is judged by its own text, whatever its id:
    repeated rows and rows without an id stay or go alike. Null and empty texts have no passage and stay, as all do where
    the benchmark is empty; a document that holds several items equally goes for any of them."""
    docs = docs.select(*COLUMNS).withColumn("_key", _text_key())
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=PASSAGE, doc_col="_key")
    return without_ids(docs, found.where(F.col("contaminated") | (F.col("longest") >= PASSAGE)).select("_key"), "_key").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, each span of personal data replaced by its kind in brackets; n_chars follows. Null texts stay
    null and empty ones empty; repeated rows are redacted alike; of spans that begin together the first kind in pii.KINDS
    names the stretch."""
    found = pii.find(docs, keep=("lang", "source"), redact=True)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, size, source_size, target, taken: the words of each document that the mix takes. Null
    and empty texts have size 0 and are never taken; a null source is one source; rows that repeat an id are taken each
    on their own, those that are equal in any order."""
    return mixing.taken_by_document(docs, keep=("lang", "source", "n_chars"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
]

#: SQL can't express the classifier, the sketches or the hashed order; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
