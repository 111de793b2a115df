"""Lifecycle hooks: plugins change the rows of the ingest as they pass, in order."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.filters import ENTITY_FLOOR, RELATIONSHIP_FLOOR, confident, domain_tag
from quillgraph.operators.ledger import average_per_call, rollup, top_documents

log = logging.getLogger(__name__)
SLOW_S = 1.0
HOOKS = ("files_discovered", "documents_parsed", "entities_extracted", "documents_completed", "documents_removed", "run_completed")


class Plugin(Protocol):
    """Any of HOOKS: each takes rows and returns rows, or None to leave them. Dropping a row from files_discovered skips
    that file."""

    name: str


class HookFailed(RuntimeError):
    pass


@dataclass
class PluginManager:
    """Runs hooks in order of registration; a failing plugin is passed over, or stops the run if registered to halt."""

    plugins: list[tuple[Plugin, bool]] = field(default_factory=list)

    def register(self, plugin: Plugin, halt: bool = False) -> PluginManager:
        self.plugins.append((plugin, halt))
        return self

    def run(self, hook: str, rows):
        if hook not in HOOKS:
            raise ValueError(f"no hook {hook}")
        for plugin, halt in self.plugins:
            f = getattr(plugin, hook, None)
            if not f:
                continue
            began = time.time()
            try:
                out = f(rows)
                rows = rows if out is None else out
            except Exception as e:
                if halt:
                    raise HookFailed(f"{plugin.name}.{hook}: {e}") from e
                log.warning("%s.%s failed and is passed over: %s", plugin.name, hook, e)
            if time.time() - began > SLOW_S:
                log.warning("%s.%s took %.1f s", plugin.name, hook, time.time() - began)
        return rows


@dataclass
class ConfidenceFilter:
    """Drops weak entities, and relationships that are weak or lose an end; rows are (entities, relationships)."""

    entity_floor: float = ENTITY_FLOOR
    relationship_floor: float = RELATIONSHIP_FLOOR
    name: str = "confidence-filter"

    def entities_extracted(self, rows: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
        return confident(*rows, self.entity_floor, self.relationship_floor)


@dataclass
class DomainTagger:
    """Puts the domain of the first rule that matches a file's path into its custom properties."""

    rules: list[tuple[str, str]]
    name: str = "domain-tagger"

    def documents_parsed(self, rows: DataFrame) -> DataFrame:
        tag = domain_tag(F.col("relative_path"), self.rules)
        own = F.coalesce("properties", F.create_map().cast("map<string,string>")) if "properties" in rows.columns else F.create_map().cast("map<string,string>")
        clean = F.map_filter(own, lambda k, v: k != "domain")
        return rows.withColumn("properties", F.when(tag.isNull(), own).otherwise(F.map_concat(clean, F.create_map(F.lit("domain"), tag))))


@dataclass
class CostReporter:
    """At the end of a run, sums of the call ledger."""

    name: str = "cost-reporter"
    report: dict | None = None

    def run_completed(self, calls: DataFrame) -> None:
        totals = rollup(calls, ["call_type", "model"]).collect()  # call types and models: a few rows
        self.report = {"totals": {(r["dimension"], r["value"]): round(r["cost"], 6) for r in totals}, "top_documents": [tuple(r) for r in top_documents(calls, "document_id").collect()], "averages": average_per_call(calls, "call_type", ["extraction", "resolution"]).first().asDict()}


BUILT_IN = {"confidence-filter": ConfidenceFilter, "domain-tagger": DomainTagger, "cost-reporter": CostReporter}


def build(entries: list[dict]) -> PluginManager:
    """From [{name, options, halt}]."""
    out = PluginManager()
    for entry in entries:
        if entry["name"] not in BUILT_IN:
            raise ValueError(f"no plugin {entry['name']}")
        out.register(BUILT_IN[entry["name"]](**entry.get("options", {})), entry.get("halt", False))
    return out
