"""Files as rows: discovery, classification and parsing into flat sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import key_id
from quillgraph.operators.filters import glob_regex
from quillgraph.sources import office

TYPES = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx"}
IGNORED = ("**/.git/**", "**/node_modules/**", "**/.DS_Store", "**/Thumbs.db", "**/~$*")
PARSED = "path string, error string, sections array<struct<seq:int,heading:string,heading_level:int,content:string,page_number:int>>, tables array<array<array<string>>>, images array<string>, title string, author string, page_count int, word_count long"


def discover(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED, types: dict[str, str] = TYPES, content: bool = True) -> DataFrame:
    """(path, relative_path, extension, size, modified, content) of the files below root with a known extension that no
    ignored glob matches, by relative or whole path. Unreadable files are passed over. Sort by path for the order of a walk."""
    exts = "{" + ",".join(f"{e},{e.upper()}" for e in sorted(types)) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{exts}").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    base = root.split(":", 1)[-1].rstrip("/") if ":" in root else root.rstrip("/")
    own = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    own = own.withColumn("relative_path", F.regexp_replace("path", "^" + base.replace(".", r"\.").replace("$", r"\$") + "/", ""))
    own = own.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    for glob in ignored:
        pattern = glob_regex(glob)
        own = own.where(~F.concat(F.lit("/"), "relative_path").rlike(pattern) & ~F.col("path").rlike(pattern))
    return own


def classify(files: DataFrame, types: dict[str, str] = TYPES) -> tuple[DataFrame, DataFrame]:
    """Files with id, file_type, content_hash and priority; and those of no known type."""
    kind = F.lit(None).cast("string")
    for ext, name in types.items():
        kind = F.when(F.col("extension") == ext, name).otherwise(kind)
    out = files.withColumn("file_type", kind)
    good = out.where(F.col("file_type").isNotNull()).withColumn("content_hash", F.sha2("content", 256)).withColumn("id", key_id("path", "content_hash"))
    return good, out.where(F.col("file_type").isNull())


def parse(files: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """office.PARSERS over files (path, file_type, content), one at a time: a row per file with its sections, or with the
    error that stopped it. Files above most_bytes give an error rather than fill a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, kind, content in zip(frame["path"], frame["file_type"], frame["content"]):
                row = {"path": path, "error": None, "sections": None, "tables": None, "images": None, "title": None, "author": None, "page_count": None, "word_count": None}
                try:
                    if kind not in office.PARSERS:
                        raise office.ParserError(f"no parser for {kind}")
                    if len(content) > most_bytes:
                        raise office.ParserError(f"{len(content)} bytes are more than {most_bytes}")
                    row |= office.PARSERS[kind](bytes(content))
                except Exception as e:  # the file's fault: told in its row
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([row])

    return files.select("path", "file_type", "content").mapInPandas(run, PARSED)


def sections(parsed: DataFrame, id_col: str = "path") -> DataFrame:
    """schemas.SECTIONS of parsed files."""
    return parsed.where("error is null").select(F.col(id_col).alias("doc_id"), F.explode("sections").alias("s")).select("doc_id", "s.*")
