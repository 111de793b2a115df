"""Readers of office files with the standard library: bytes in, flat sections, tables, images and metadata out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

NOTES = "\n\n---SPEAKER NOTES---\n"
TITLE_CHARS, SAMPLE_ROWS = 120, 8


class ParserError(ValueError):
    pass


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ParserError("not a zip archive") from e


def _name(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _attr(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _all(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node.iter() if _name(x) == name]


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _text(node: ET.Element) -> str:
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_name(x), "") for x in node.iter())


def _words(sections: list[dict]) -> int:
    return sum(len(s["content"].split()) for s in sections)


def _numbered(rows: list[tuple]) -> list[dict]:
    return [{"seq": i, "heading": h, "heading_level": lv, "content": c, "page_number": p} for i, (h, lv, c, p) in enumerate(rows)]


def _properties(z: zipfile.ZipFile) -> dict:
    if "docProps/core.xml" not in z.namelist():
        return {}
    found = {_name(x): x.text for x in ET.fromstring(z.read("docProps/core.xml"))}
    return {k: found[n] for k, n in (("title", "title"), ("author", "creator")) if found.get(n)}


def docx(data: bytes) -> dict:
    """Headings open sections of their level; paragraphs, lists (a line with a dash per item) and tables (cells joined by
    tabs) are sections without heading, in the order of the body."""
    z = _open(data)
    if "word/document.xml" not in z.namelist():
        raise ParserError("no document in the archive")
    levels = {}
    if "word/styles.xml" in z.namelist():
        for style in _all(ET.fromstring(z.read("word/styles.xml")), "style"):
            name = next((_attr(n, "val") or "" for n in style if _name(n) == "name"), "")
            if m := re.fullmatch(r"heading ([1-6])", name.lower()):
                levels[_attr(style, "styleId")] = int(m[1])
    rows, tables, items = [], [], []

    def close() -> None:
        if items:
            rows.append((None, 0, "\n".join(f"- {i}" for i in items), None))
            items.clear()

    body = _all(ET.fromstring(z.read("word/document.xml")), "body")
    for node in body[0] if body else []:
        kind = _name(node)
        if kind == "tbl":
            close()
            table = [[_flat(" ".join(_text(p) for p in _all(c, "p"))) for c in r if _name(c) == "tc"] for r in node if _name(r) == "tr"]
            table = [r for r in table if r]
            if table:
                tables.append(table)
                rows.append((None, 0, "\n".join("\t".join(r) for r in table), None))
        elif kind == "p":
            style = next((_attr(s, "val") for s in _all(node, "pStyle")), None)
            level = levels.get(style) or (int(m[1]) if (m := re.fullmatch(r"[Hh]eading ?([1-6])", style or "")) else None)
            text = _flat(_text(node))
            if not text:
                continue
            if _all(node, "numPr") and not level:
                items.append(text)
                continue
            close()
            rows.append((text, level, text, None) if level else (None, 0, text, None))
    close()
    sections = _numbered(rows)
    return {"sections": sections, "tables": tables, "images": [n for n in z.namelist() if n.startswith("word/media/")], "word_count": _words(sections)} | _properties(z)


def _slide_number(name: str) -> int:
    m = re.search(r"slide(\d+)\.xml$", name, re.I)
    return int(m[1]) if m else 0


def pptx(data: bytes) -> dict:
    """A slide's title (its title shape, else a short first shape) is a heading; its other shapes, then its notes after a
    mark, are the body. Slides come in the order of their numbers."""
    z = _open(data)
    names = set(z.namelist())
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_slide_number)
    rows = []
    for name in slides:
        number = _slide_number(name)
        shapes = []
        for sp in _all(ET.fromstring(z.read(name)), "sp"):
            text = "\n".join(t for p in _all(sp, "p") if (t := _text(p).strip()))
            if text:
                shapes.append((any(_attr(p, "type") in ("title", "ctrTitle") for p in _all(sp, "ph")), text))
        title = next((t for is_title, t in shapes if is_title), None)
        body = [t for is_title, t in shapes if not is_title]
        if title is None and shapes and len(shapes[0][1]) <= TITLE_CHARS and "\n" not in shapes[0][1]:
            title = shapes[0][1]
            body = body[1:] if len(shapes) > 1 else body
        notes = f"ppt/notesSlides/notesSlide{number}.xml"
        said = _flat(" ".join(x.text or "" for x in _all(ET.fromstring(z.read(notes)), "t"))) if notes in names else ""
        if title:
            rows.append((title, 1, title, number))
        content = "\n".join(body) + (NOTES + said if said else "")
        if content.strip():
            rows.append((None, 0, content, number))
    sections = _numbered(rows)
    return {"sections": sections, "tables": [], "images": sorted(n for n in names if n.startswith("ppt/media/")), "page_count": len(slides), "word_count": _words(sections)} | _properties(z)


# Number formats of spreadsheets that show dates.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet(z: zipfile.ZipFile, path: str, strings: list[str], dated: set[int]) -> list[list]:
    """Cells as None, float, bool, str or datetime; formulas as their stored values; empty rows left out."""
    rows = []
    for row in _all(ET.fromstring(z.read(path)), "row"):
        cells: dict[int, object] = {}
        for n, c in enumerate(x for x in row if _name(x) == "c"):
            kind = c.get("t")
            value = next((v.text for v in c if _name(v) == "v"), None)
            if kind == "inlineStr":
                value = _text(c)
            elif value is None:
                continue
            elif kind == "s":
                value = strings[int(value)]
            elif kind == "b":
                value = value == "1"
            elif kind not in ("str", "e"):
                value = float(value)
                if int(c.get("s") or 0) in dated:
                    value = datetime(1899, 12, 30) + timedelta(days=value)
            cells[_column(c.get("r") or "") if c.get("r") else n] = value
        if cells:
            rows.append([cells.get(i) for i in range(max(cells) + 1)])
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]


def _shown(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d")
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _csv(rows: list[list]) -> str:
    quoted = lambda s: '"' + s.replace('"', '""') + '"' if re.search('[",\n]', s) else s
    return "\n".join(",".join(quoted(_shown(c)) for c in r) for r in rows)


def column_type(values: list) -> str:
    own = [v for v in values if v is not None and v != ""]
    if not own:
        return "empty"
    n = sum(isinstance(v, float) for v in own)
    d = sum(isinstance(v, datetime) for v in own)
    votes = {"number": n, "date": d, "string": len(own) - n - d}
    best = max(votes, key=votes.get)
    return best if votes[best] / len(own) >= 0.5 else "mixed"


def xlsx(data: bytes) -> dict:
    """Each sheet is a heading; a data table is told by its columns, their types and its first rows as CSV, any other
    sheet by its cells joined by tabs."""
    z = _open(data)
    if "xl/workbook.xml" not in z.namelist():
        raise ParserError("no workbook in the archive")
    strings = [_text(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml")) if _name(x) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    dated: set[int] = set()
    if "xl/styles.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(_attr(f, "numFmtId")): _attr(f, "formatCode") or "" for f in _all(root, "numFmt")}
        xfs = next((x for x in root if _name(x) == "cellXfs"), [])
        for i, xf in enumerate(xfs):
            code = int(xf.get("numFmtId") or 0)
            if code in DATE_FORMATS or re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(code, "")), re.I):
                dated.add(i)
    targets = {_attr(r, "Id"): _attr(r, "Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in z.namelist() else {}
    rows, tables, sheets = [], [], _all(ET.fromstring(z.read("xl/workbook.xml")), "sheet")
    for n, sheet in enumerate(sheets, 1):
        title = sheet.get("name") or f"Sheet{n}"
        target = targets.get(_attr(sheet, "id"), f"worksheets/sheet{n}.xml").lstrip("/")
        matrix = _sheet(z, target if target.startswith("xl/") else f"xl/{target}", strings, dated)
        rows.append((title, 1, title, None))
        if not matrix:
            continue
        heads = [c.strip() if isinstance(c, str) else "" for c in matrix[0]]
        kinds = [column_type([r[i] for r in matrix[1:]]) for i in range(len(heads))]
        named = len(heads) > 1 and all(heads) and len(set(heads)) == len(heads) and len(matrix) > 1
        if named and sum(k not in ("mixed", "empty") for k in kinds) / len(heads) >= 0.5:
            sample = matrix[1 : 1 + SAMPLE_ROWS]
            shape = ", ".join(f"{h} ({k})" for h, k in zip(heads, kinds))
            rows.append((None, 0, f"This worksheet contains {len(matrix) - 1} rows with columns: {shape}.\n\nSample rows (first {len(sample)}):\n{_csv([heads, *sample])}", None))
        else:
            text = "\n".join("\t".join(_shown(c) for c in r) for r in matrix)
            if not text.strip():
                continue
            rows.append((None, 0, text, None))
        tables.append([[_shown(c) for c in r] for r in matrix])
    sections = _numbered(rows)
    return {"sections": sections, "tables": tables, "images": [], "page_count": len(sheets), "word_count": _words(sections)} | _properties(z)


#: There is no PDF reader in the standard library; a reader can be added here under "pdf".
PARSERS: dict[str, Callable[[bytes], dict]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx}
