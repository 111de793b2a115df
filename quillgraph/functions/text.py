"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count two."""
    c = col(c)
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def token_estimate(c: Column | str) -> Column:
    """A token per four UTF-16 units, rounded up; 0 for the empty string."""
    return F.ceil(utf16_length(c) / 4).cast("long")


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda w: w != "")).cast("long")


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def query_hash(c: Column | str) -> Column:
    return F.substring(content_hash(c), 1, 12)


def key_id(*parts: Column | str) -> Column:
    """A deterministic id of a key: retried tasks give the same one."""
    return F.sha2(F.concat_ws("\x01", *(F.coalesce(col(p).cast("string"), F.lit("\x02")) for p in parts)), 256)


def safe_filename(path: Column | str) -> Column:
    """Last part of a path, with `_` for all but letters, digits, dot, underscore and hyphen."""
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"[^A-Za-z0-9._-]", "_")


def truncate(c: Column | str, n: int | Column) -> Column:
    """At most n characters, the last of which is an ellipsis where something was cut."""
    c, n = col(c), F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit("…")))


def citation_line(key: Column, file_name: Column, page: Column, heading: Column, content: Column) -> Column:
    """`[k] (Document: f, p.N, "H"): text`, leaving out what is null or empty."""
    some = lambda c, x: F.when(c.isNotNull() & (c.cast("string") != ""), x)
    head = F.concat_ws(", ", some(file_name, F.concat(F.lit("Document: "), file_name)), F.concat(F.lit("p."), page.cast("string")), some(heading, F.concat(F.lit('"'), heading, F.lit('"'))))
    return F.concat(F.lit("["), key.cast("string"), F.lit("]"), F.when(head != "", F.concat(F.lit(" ("), head, F.lit(")"))).otherwise(""), F.lit(": "), content)


def relationship_line(source: Column, kind: Column, target: Column, evidence: Column) -> Column:
    """`(A) --[T]--> (B) [evidence: ...]`, with the first piece of evidence."""
    first = F.get(evidence, F.lit(0))
    shown = F.when(first.isNotNull() & (first != ""), F.concat(F.lit(" [evidence: "), truncate(first, 120), F.lit("]"))).otherwise("")
    return F.concat(F.lit("("), source, F.lit(") --["), kind, F.lit("]--> ("), target, F.lit(")"), shown)


def relationship_type(c: Column | str) -> Column:
    """Upper case, `_` for what isn't a letter, digit or underscore; RELATED_TO for the empty string."""
    name = F.upper(F.regexp_replace(col(c), r"[^A-Za-z0-9_]", "_"))
    return F.when(name == "", "RELATED_TO").otherwise(name)


def chunk_embedding_text(path: Column, content: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n"), content)).otherwise(content)


def entity_embedding_text(name: Column, kind: Column, contexts: Column) -> Column:
    text = F.substring(F.array_join(contexts, " "), 1, 500)
    return F.concat(name, F.lit(" ("), kind, F.lit("): "), text)


def size_priority(size: Column | str) -> Column:
    """1 to 1000, smaller files first; 1 for no size."""
    n = col(size)
    return F.when(n <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(1000), F.round(F.log10(n + 1) * 100)))).cast("int")


def call_cost(n_in: Column, n_out: Column, price_in: Column, price_out: Column) -> Column:
    """USD, prices being per million tokens; a missing price is 0."""
    zero = F.lit(0.0)
    return n_in / 1e6 * F.coalesce(price_in, zero) + n_out / 1e6 * F.coalesce(price_out, zero)


def heading_level(tag: Column | str) -> Column:
    return F.regexp_extract(col(tag), r"^[hH]([1-6])$", 1).try_cast("int")


def slide_number(path: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(col(path), r"slide(\d+)\.xml$", 1).try_cast("int"), F.lit(0))


def tsv_cell(c: Column | str) -> Column:
    """Empty for null, the day for timestamps at midnight UTC; nothing is quoted."""
    return F.coalesce(F.regexp_replace(col(c).cast("string"), r"^(\d{4}-\d{2}-\d{2})[ T]00:00:00(?:\.0+)?Z?$", "$1"), F.lit(""))


def csv_cell(c: Column | str) -> Column:
    """tsv_cell, quoted where a comma, quote or line end is inside."""
    s = tsv_cell(c)
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def table_text(rows: Column | str, sep: str = ",") -> Column:
    """A table, an array of arrays of strings, as lines of comma-separated cells or, with another `sep`, of bare ones."""
    cell = csv_cell if sep == "," else tsv_cell
    return F.array_join(F.transform(col(rows), lambda row: F.array_join(F.transform(row, cell), sep)), "\n")


def properties_json(c: Column | str) -> Column:
    """Properties (a map) as JSON; null is an empty object."""
    return F.coalesce(F.to_json(col(c)), F.lit("{}"))


def properties_of(c: Column | str) -> Column:
    """Properties from JSON; what is no object of JSON gives null, and values that are no strings their JSON."""
    return F.from_json(col(c), "map<string,string>")


def orphan_citations(answer: Column | str, allowed: Column) -> Column:
    """Distinct [n] of an answer that name no allowed key, ascending."""
    cited = F.transform(F.regexp_extract_all(col(answer), F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    return F.array_sort(F.array_except(cited, allowed))


def is_transient(status: Column, message: Column) -> Column:
    """Whether a failed call may be tried again."""
    # HTTP statuses that may pass.
    return F.coalesce(status.isin(408, 425, 429, 500, 502, 503, 504), F.lit(False)) | F.coalesce(message.rlike("(?i)timeout|network|fetch"), F.lit(False))


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and that letter; built from the Unicode data at hand."""
    pairs = []
    for i in range(0xC0, 0x3000):
        plain = [c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c)]
        if unicodedata.category(chr(i)).startswith("L") and len(plain) == 1 and plain[0] != chr(i):
            pairs.append((chr(i), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_diacritics(c: Column | str) -> Column:
    """Without accents, and without the spacing marks that count as diacritics."""
    return F.regexp_replace(F.translate(col(c), *_accents()), "[\\p{Mn}^`¨¯´·¸]", "")


# Forms of companies, titles and degrees that names are compared without.
COMPANY_FORMS = ("inc.?", "incorporated", "corp.?", "corporation", "co.?", "company", "ltd.?", "limited", "llc", "llp", "gmbh", "s.?\\s?a.?", "ag", "n.?\\s?v.?", "plc", "pty.?", "spa")
TITLES = ("dr.?", "mr.?", "mrs.?", "ms.?", "miss", "prof.?", "professor", "sir", "dame", "hon.?", "rev.?")
DEGREES = ("phd", "ph.d.?", "md", "m.d.?", "esq.?", "jr.?", "sr.?", "ii", "iii", "iv", "cpa", "cfa", "mba", "jd")
DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


def _any(forms: tuple[str, ...]) -> str:
    return "|".join(f.replace(".", r"\.") for f in forms)


def company_pattern(strict: bool = False) -> str:
    """Forms at the end of a name. Unless strict, no separator need stand before one, so `visa` ends in `sa`."""
    return rf"(?:(?:,\s*|\s+)(?:{_any(COMPANY_FORMS)})\b\.?)+$" if strict else rf"(?:,?\s*(?:{_any(COMPANY_FORMS)})\b\.?)+$"


def title_pattern() -> str:
    return rf"^(?:{_any(TITLES)})\s+"


def degree_pattern() -> str:
    return rf",?\s+(?:{_any(DEGREES)})\b\.?$"


def normalize_entity_name(name: Column | str, kind: Column | str, strict_suffix: bool = False, passes: int = 4) -> Column:
    """A name to compare by: dates as ISO days where they can be read; else without accents, in lower case, white space
    collapsed, companies without their form and persons without titles and degrees (repeated up to `passes` times),
    punctuation but hyphens as spaces."""
    name, kind = col(name), col(kind)
    plain = collapse_whitespace(F.lower(strip_diacritics(name)))
    company, person = plain, plain
    for _ in range(passes):
        company = collapse_whitespace(F.regexp_replace(company, company_pattern(strict_suffix), ""))
    for _ in range(passes):
        person = F.regexp_replace(person, title_pattern(), "")
    for _ in range(passes):
        person = F.regexp_replace(person, degree_pattern(), "")
    out = F.when(kind == "Organization", company).when(kind == "Person", person).otherwise(plain)
    out = collapse_whitespace(F.regexp_replace(out, r"(?U)[^\p{L}\p{N}\s-]", " "))
    read = F.coalesce(*(F.try_to_timestamp(F.trim(name), F.lit(f)) for f in DATE_FORMATS))
    date = F.coalesce(F.date_format(read, "yyyy-MM-dd"), collapse_whitespace(F.lower(name)))
    return F.when(name.isNull() | (name == ""), "").when(kind == "Date", date).otherwise(out)
