"""Prompts for the models that extract, judge and answer, as column expressions or plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACT_RULES = """You build a knowledge graph. Take from the text below the entities and relationships that it states.
Use no types but those listed. Name entities in full and add other spellings as aliases. Quote one sentence of the text as
evidence of each relationship. Leave out what the text doesn't say. Give a confidence from 0 to 1 for each."""

JUDGE_RULES = """Do two names mean the same thing in the real world? Reply `same` or `different`, with a confidence from 0 to 1
and a reason of one sentence. Names that only look alike are different. When in doubt, reply `different`."""

ANSWER_RULES = """Answer from the numbered context alone. Put the number of its source, as [N], behind each claim, and use no
number that the context doesn't have. If the context doesn't hold the answer, say so and set confident to false. Reply as
JSON with answer, citations and confident."""


def entity_types(types: Column) -> Column:
    """A line per type of an ontology: array of (name, description, properties, examples)."""
    line = lambda t: F.concat(F.lit("- "), t["name"], F.lit(": "), t["description"], F.when(F.size(t["properties"]) > 0, F.concat(F.lit(" Properties: "), F.array_join(t["properties"], ", "), F.lit("."))).otherwise(""), F.when(F.size(t["examples"]) > 0, F.concat(F.lit(" Examples: "), F.array_join(t["examples"], " / "), F.lit("."))).otherwise(""))
    return F.array_join(F.transform(types, line), "\n")


def relationship_types(types: Column) -> Column:
    """A line per type: array of (name, description, source_types, target_types); `*` is any."""
    side = lambda a: F.when(F.array_contains(a, "*"), "any").otherwise(F.array_join(a, "/"))
    line = lambda t: F.concat(F.lit("- "), t["name"], F.lit(": "), t["description"], F.lit(" ("), side(t["source_types"]), F.lit(" → "), side(t["target_types"]), F.lit(")"))
    return F.array_join(F.transform(types, line), "\n")


def extraction_user(path: Column, section: Column, pages: Column, content: Column) -> Column:
    under = F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise("(none)")
    on = F.when(F.size(pages) > 0, F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")).otherwise("unknown")
    return F.concat_ws("\n", F.concat(F.lit("Headings: "), under), F.concat(F.lit("Section: "), section), F.concat(F.lit("Pages: "), on), F.lit(""), F.lit("Text:"), content)


def judge_user(kind: Column, name_a: Column, aliases_a: Column, context_a: Column, name_b: Column, aliases_b: Column, context_b: Column) -> Column:
    one = lambda letter, name, aliases, context: F.concat(F.lit(f"{letter}: "), name, F.when(F.size(aliases) > 0, F.concat(F.lit(" (also "), F.array_join(aliases, ", "), F.lit(")"))).otherwise(""), F.lit("\nSeen in: "), F.coalesce(context, F.lit("(nothing)")))
    return F.concat_ws("\n", F.concat(F.lit("Type: "), kind), one("A", name_a, aliases_a, context_a), one("B", name_b, aliases_b, context_b))
