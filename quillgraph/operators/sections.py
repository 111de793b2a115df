"""From lines to headings and paragraphs, and from sections to chunks."""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.text import collapse_whitespace
from quillgraph.schemas import CHUNKS

log = logging.getLogger(__name__)
HEADING_CHARS = 80


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seq, line) for each line of a text."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("seq", "line"))


def heading_candidates(rows: DataFrame, group: str = "doc_id") -> DataFrame:
    """Lines with is_heading: short, without an end mark, with a letter, and before a blank line or the end."""
    after = F.lead("line").over(Window.partitionBy(group).orderBy("seq"))
    t = F.trim("line")
    ok = (F.length(t) > 0) & (F.length(t) <= HEADING_CHARS) & ~t.rlike(r"[.!?:;]$") & t.rlike(r"\p{L}") & (after.isNull() | (F.trim(after) == ""))
    return rows.withColumn("is_heading", ok)


def paragraphs(rows: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, first_seq, paragraph): runs of lines between blank ones and headings, joined by spaces; a heading only
    counts where no paragraph is open."""
    w = Window.partitionBy(group).orderBy("seq")
    marked = heading_candidates(rows, group).withColumn("_blank", F.trim("line") == "")
    marked = marked.withColumn("_free", F.coalesce(F.lag("_blank").over(w), F.lit(True)))
    marked = marked.withColumn("_head", F.col("is_heading") & F.col("_free"))
    marked = marked.withColumn("_island", F.sum((F.col("_blank") | F.col("_head")).cast("int")).over(w))
    body = marked.where(~F.col("_blank") & ~F.col("_head"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), " ")
    return body.groupBy(group, "_island").agg(F.min("seq").alias("first_seq"), collapse_whitespace(joined).alias("paragraph")).drop("_island")


def greedy_groups(items: Column, target: int) -> Column:
    """For an ordered array of sizes, the number of the group that each falls in: a group is closed before the size that
    would take it over the target."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        new = (s["used"] > 0) & (s["used"] + n > target)
        group = F.when(new, s["group"] + 1).otherwise(s["group"])
        return F.struct(F.when(new, n).otherwise(s["used"] + n).alias("used"), group.alias("group"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


@dataclass(frozen=True)
class ChunkOptions:
    target: int = 500
    overlap: int = 50
    minimum: int = 0
    maximum: int = 2000

    def __post_init__(self):
        if self.target <= 0 or self.overlap < 0 or self.overlap >= self.target:
            raise ValueError("the target must be above 0 and above the overlap")


def _tokens(s: str) -> int:
    return -(-len(s.encode("utf-16-le")) // 8)


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text) if s]


def _pieces(text: str, target: int) -> list[str]:
    """Parts of at most `target` tokens where words allow it: paragraphs, else sentences, else words, else characters."""
    if _tokens(text) <= target:
        return [text]
    for cut in (lambda t: [p for p in re.split(r"\n\s*\n", t) if p.strip()], _sentences, str.split):
        parts = cut(text)
        if len(parts) > 1:
            return [q for p in parts for q in _pieces(p, target)]
    return [text[i : i + 4 * target] for i in range(0, len(text), 4 * target)]


def _is_table(text: str) -> bool:
    rows = [r for r in text.split("\n") if r.strip()]
    return len(rows) > 1 and all("\t" in r for r in rows)


def chunk_sections(rows: list[dict], o: ChunkOptions) -> Iterator[dict]:
    """Chunks of one document's sections, in order. Headings open a level and give no chunk of their own; chunks don't
    cross sections, but for a tail below the minimum that moves into the next; tables stand alone. A section that lists its
    paragraphs instead of a content keeps each whole and as it is, also one above the target or with blank lines."""
    path: list[tuple[int, str]] = []
    out: list[dict] = []
    carry: str = ""
    carried: list[int] = []
    for n, row in enumerate(rows):
        listed = row.get("paragraphs")
        listed = None if listed is None else [p for p in listed if p is not None]
        text = (row["content"] or "").strip() if listed is None else "\n\n".join(listed)
        if row["heading"]:
            level = row["heading_level"] or 1
            path = [(lv, h) for lv, h in path if lv < level] + [(level, row["heading"])]
        here = [] if row["page_number"] is None else [int(row["page_number"])]
        parts = [(carry, carried), (text, here)]
        text, carry, carried = "\n\n".join(x for x, _ in parts if x), "", []
        if not text and not listed:
            continue
        made: list[list[str]] = []
        pages: list[set[int]] = []
        if listed is None and _is_table(text):
            made, kind, pages = [[text]], "table", [{p for x, on in parts if x for p in on}]
            if _tokens(text) > o.maximum:
                log.warning("a table of %d tokens is one chunk, above the maximum of %d", _tokens(text), o.maximum)
        else:
            kind = "text"
            budget = max(1, o.target - o.overlap)
            used = 0
            split = lambda x: (q for p in re.split(r"\n\s*\n", x) if p.strip() for q in _pieces(p.strip(), budget))
            pieces = [(q, on) for x, on in (parts if listed is None else parts[:1]) for q in split(x)] + [(p, here) for p in listed or ()]
            for piece, on in pieces:
                if not made or used + _tokens(piece) > budget:
                    made.append([])
                    pages.append(set())
                    used = 0
                made[-1].append(piece)
                pages[-1].update(on)
                used += _tokens(piece)
        bodies = ["\n\n".join(m) for m in made]
        if kind == "text" and o.minimum and n + 1 < len(rows) and _tokens(bodies[-1]) < o.minimum:
            carry, carried = bodies.pop(), sorted(pages.pop())
        for i, body in enumerate(bodies):
            lead = ""
            if i and o.overlap and kind == "text":
                for s in reversed(_sentences(bodies[i - 1])):
                    if _tokens(f"{s} {lead}") > o.overlap:
                        break
                    lead = f"{s} {lead}".strip()
            content = f"{lead} {body}" if lead else body
            out.append({"content": content, "heading_path": [h for _, h in path], "pages": sorted(pages[i]), "tokens": _tokens(content), "kind": kind, "section_title": path[-1][1] if path else None, "first_in_section": i == 0, "last_in_section": i == len(bodies) - 1, "overlap": lead or None})
    if carry:
        out.append({"content": carry, "heading_path": [h for _, h in path], "pages": carried, "tokens": _tokens(carry), "kind": "text", "section_title": path[-1][1] if path else None, "first_in_section": True, "last_in_section": True, "overlap": None})
    for seq, c in enumerate(out):
        yield c | {"seq": seq}


def chunk_documents(sections: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks (schemas.CHUNKS) of sections (schemas.SECTIONS, with or without an array column paragraphs, see chunk_sections).
    Packing goes on within a document only, so documents are dealt out by id and one at a time is in memory; ids are hashes
    of document, place and content."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = str(pdf["doc_id"].iloc[0])
        rows = pdf.sort_values("seq").astype(object).where(pdf.sort_values("seq").notna(), None).to_dict("records")
        made = [c | {"doc_id": doc, "chunk_id": hashlib.sha256(f"{doc}|{c['seq']}|{c['content']}".encode()).hexdigest()} for c in chunk_sections(rows, options)]
        return pd.DataFrame(made, columns=[f.split(" ")[0] for f in CHUNKS.split(", ")])

    return sections.groupBy("doc_id").applyInPandas(one, CHUNKS)
