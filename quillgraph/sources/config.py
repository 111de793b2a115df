"""Settings: defaults, a file for the environment, then environment variables."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Chunker:
    target_tokens: int = 500
    overlap_tokens: int = 50
    min_chunk_tokens: int = 0
    max_chunk_tokens: int = 2000


@dataclass(frozen=True)
class Resolution:
    enabled: bool = True
    similarity_threshold: float = 0.92
    max_candidates: int = 5
    skip_types: tuple[str, ...] = ("Date", "Metric")


@dataclass(frozen=True)
class Cost:
    budget_per_run: float | None = None
    budget_per_document: float | None = None
    warn_at: float = 0.8


@dataclass(frozen=True)
class Api:
    timeout_ms: int = 30_000
    max_rows: int = 10_000
    token: str | None = None


@dataclass(frozen=True)
class Retrieval:
    enabled: bool = True
    paragraph_top_k: int = 10
    entity_top_k: int = 10
    max_hops: int = 2
    layout_window: int = 1
    max_context_tokens: int = 4000
    rank_alpha: float = 0.7


@dataclass(frozen=True)
class Config:
    chunker: Chunker = field(default_factory=Chunker)
    resolution: Resolution = field(default_factory=Resolution)
    cost: Cost = field(default_factory=Cost)
    api: Api = field(default_factory=Api)
    rag: Retrieval = field(default_factory=Retrieval)
    hybrid: Retrieval = field(default_factory=lambda: Retrieval(paragraph_top_k=15, entity_top_k=15))


def deep_merge(base: dict, over: dict) -> dict:
    """`over` laid on `base`, table by table; lists are replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in over.items()}


def _build(kind, values: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ConfigError(f"{where or 'top'}: unknown {sorted(extra)}")
    out = {}
    for name, v in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        if is_dataclass(default):
            if not isinstance(v, dict):
                raise ConfigError(f"{where}{name}: a table is wanted")
            out[name] = _build(type(default), v, f"{where}{name}.")
        elif isinstance(default, tuple):
            out[name] = tuple(v)
        elif default is not None and not isinstance(v, (int, float) if isinstance(default, float) else type(default)):
            raise ConfigError(f"{where}{name}: {v!r} is no {type(default).__name__}")
        else:
            out[name] = v
    return kind(**out)


def load_config(directory: str | None = None, path: str | None = None, env: dict[str, str] | None = None, name: str | None = None) -> Config:
    """default.toml and {name}.toml of a directory, or `path` alone; then variables such as QUILL_API__MAX_ROWS."""
    env = dict(os.environ) if env is None else env
    layers = [path] if path else [f"{directory}/default.toml", f"{directory}/{name or env.get('QUILL_ENV', 'development')}.toml"] if directory else []
    merged: dict = {}
    for layer in layers:
        if Path(layer).exists():
            merged = deep_merge(merged, tomllib.loads(Path(layer).read_text()))
        elif path:
            raise ConfigError(f"no file {path}")
    for key, value in env.items():
        if key.startswith("QUILL_") and "__" in key:
            part, _, leaf = key.removeprefix("QUILL_").lower().partition("__")
            try:
                value = tomllib.loads(f"x = {value}")["x"]
            except tomllib.TOMLDecodeError:
                pass
            merged = deep_merge(merged, {part: {leaf: value}})
    return _build(Config, merged, "")


def load_pricing(spark: SparkSession, path: str) -> DataFrame:
    """(model, input_per_million, output_per_million) of a price list in TOML: some tens of rows."""
    rows = tomllib.loads(Path(path).read_text()).get("models", {})
    return spark.createDataFrame([(m, float(p.get("input_per_million", 0)), float(p.get("output_per_million", 0))) for m, p in rows.items()], "model string, input_per_million double, output_per_million double")


def load_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entity types and relationship types of an ontology in JSON."""
    both = spark.read.option("multiLine", True).json(path)
    return both.selectExpr("inline(entityTypes)"), both.selectExpr("inline(relationshipTypes)")
