"""Filters and tags of the ingest pipeline."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_FLOOR, RELATIONSHIP_FLOOR = 0.5, 0.6


def confident(entities: DataFrame, relationships: DataFrame, entity_floor: float = ENTITY_FLOOR, relationship_floor: float = RELATIONSHIP_FLOOR) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk_id, name, confidence) and relationships (chunk_id, source, target, confidence) at or above their
    floors; a relationship also needs both ends kept in its chunk."""
    kept = entities.where(F.col("confidence") >= entity_floor)
    names = kept.select("chunk_id", "name").distinct()
    end = lambda df, c: df.join(names.select(F.col("chunk_id").alias("_c"), F.col("name").alias("_n")), (F.col("chunk_id") == F.col("_c")) & (F.col(c) == F.col("_n")), "left_semi")
    return kept, end(end(relationships.where(F.col("confidence") >= relationship_floor), "source"), "target")


def glob_regex(glob: str, one_is_any: bool = False) -> str:
    """Anchored regular expression of a glob: ** is anything, * anything but a slash, ? one character but a slash (any
    character with one_is_any)."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "." if one_is_any else "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def domain_tag(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The domain of the first rule (glob, domain) that matches, else null. A glob that begins with **/ also matches at
    the top."""
    out = F.lit(None).cast("string")
    for glob, domain in reversed(rules):
        hit = path.rlike(glob_regex(glob, True)) | F.concat(F.lit("/"), path).rlike(glob_regex(glob, True))
        out = F.when(hit, domain).otherwise(out)
    return out


def unchanged_skipped(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files without a completed log row of the same path and hash."""
    done = log.where(F.col("status") == "completed").select("file_path", "content_hash")
    return files.join(done, ["file_path", "content_hash"], "left_anti")


def name_contains(entities: DataFrame, needle: str) -> DataFrame:
    """Entities whose name or an alias has `needle` in it, whatever the case."""
    low = needle.lower()
    return entities.where(F.contains(F.lower("name"), F.lit(low)) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(low))), F.lit(False)))


def find_nodes(nodes: DataFrame, labels: list[str] | None = None, where: dict | None = None, limit: int = 100, order: str = "id") -> DataFrame:
    """Nodes with all labels and equal properties, at most `limit`, in order of id."""
    out = nodes
    for label in labels or []:
        out = out.where(F.array_contains("labels", label))
    for k, v in (where or {}).items():
        out = out.where(F.col(k) == F.lit(v))
    return out.orderBy(order).limit(limit)
