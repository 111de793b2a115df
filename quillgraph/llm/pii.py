"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.kernels import slices, text_bytes

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans that start together are listed.
KINDS = (*BASE, "national_id", "secret", "name")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No digit may precede: a match that can't start with a run of digits can't start inside it either.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGIT = re.compile(r"[0-9]")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The regular expression's matches, from each @ outward, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str, digits: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; digits: whether there are any."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if digits:
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# Candidate spans beside the base kinds; a secret is a whole run, of any length, that has a digit.
_CANDIDATES = (
    ("phone", True, re.compile(r"(?<![0-9])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    ("national_id", True, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("secret", True, re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+")),
    ("name", False, re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][^\W\d_]+(?: [A-Z][^\W\d_]+)?")),
)
# Words before a span that speak for it, by kind, and given names for the gazetteer.
_CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "national_id": ("ssn", "social", "security", "id"),
    "secret": ("token", "key", "secret", "password", "bearer", "api"),
    "name": ("by", "from", "dear", "signed", "contact"),
}
_GIVEN = frozenset("james john robert mary linda anna maria jane peter paul thomas michael david laura julia hans karl jean pierre marie jose juan carmen lucia sofia emma".split())
_AGAINST = ("version", "isbn", "page", "total", "price", "chapter", "figure", "eur", "usd")
LABELERS = ("shape", "gazetteer", "context", "contrary", "variety")


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler: 1 for personal data, -1 against, 0 for none."""
    body = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    near = re.findall(r"[^\W\d_]+", before)[-4:]
    digits = sum(map(str.isdigit, body))
    if kind == "secret":
        shape = 1 if len(body) in (32, 40, 64) and re.fullmatch(r"[0-9a-fA-F]+", body) else (-1 if "/" in body and body.count("/") > 2 else 0)
    elif kind == "phone":
        shape = 1 if body[0] == "(" or body.count("-") == 2 else 0
    elif kind == "national_id":
        shape = -1 if body[:3] in ("000", "666") or body[0] == "9" else 1
    else:
        shape = 1 if body.count(" ") > 1 else 0
    gazetteer = (1 if any(w.lower() in _GIVEN for w in body.split()) else 0) if kind == "name" else (1 if kind == "phone" and "555" in body else 0)
    context = 1 if any(w in _CUES[kind] for w in near) else 0
    contrary = -1 if any(w in _AGAINST for w in near) else 0
    kinds = len(set(body))
    variety = (1 if kinds >= 8 else -1) if kind == "secret" else (-1 if digits and kinds <= 3 else 0)
    return shape, gazetteer, context, contrary, variety


def _code(kind: str, v: tuple[int, ...], body: str) -> int:
    """Kind, votes and the size of the span as one number: all that the models see."""
    out = KINDS.index(kind)
    for x in v:
        out = out * 3 + x + 1
    return out * 4 + min(3, len(body) // 12)


def decode(code: int) -> tuple[int, list[int], int]:
    size, code = code % 4, code // 4
    v = []
    for _ in LABELERS:
        v.append(code % 3 - 1)
        code //= 3
    return code, v[::-1], size


def candidates(text: str, taken: list[tuple[int, int, str]], digits: bool) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, code) of spans that overlap no base span."""
    out = []
    begin = [a for a, *_ in taken]
    reach = list(accumulate((b for _, b, _ in taken), max))
    for kind, need, pattern in _CANDIDATES:
        if need and not digits:
            continue
        for m in pattern.finditer(text):
            if kind == "secret" and not _DIGIT.search(m[0]):
                continue
            before = bisect_left(begin, m.end())  # of the base spans that begin before its end none may reach into it
            if not before or reach[before - 1] <= m.start():
                out.append((*m.span(), kind, _code(kind, votes(kind, text, *m.span()), m[0])))
    return sorted(out)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over the counted vote patterns (rows of -1, 0, 1).

    Returns each pattern's probability of personal data and, per labeler, [class, vote] probabilities. It starts from
    the majority and keeps a little mass everywhere, so labelers that never vote stay neutral.
    """
    p = 1 / (1 + np.exp(-patterns.sum(1).astype(float) - 0.25))
    table = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = weight[:, patterns[:, j] == v].sum(1) + 0.5
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(table[j][:, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return p, table


def _features(codes: list[int]) -> np.ndarray:
    rows = []
    for code in codes:
        kind, v, size = decode(code)
        rows.append([1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(x == 1) for x in v), *(float(x == -1) for x in v), *(float(size == s) for s in range(4))])
    return np.array(rows).reshape(len(codes), -1)


def train(counted: dict[int, int], rounds: int = 300) -> dict[int, float]:
    """Probability of each code: logistic regression on kind, votes and size, taught the posteriors of EM, each code
    weighing as often as it was seen."""
    if not counted:
        return {}
    codes = sorted(counted)
    counts = np.array([counted[c] for c in codes], float)
    target, _ = reliabilities(np.array([decode(c)[1] for c in codes]), counts)
    x, w = _features(codes), np.zeros(_features(codes).shape[1])
    share = np.sqrt(counts) / np.sqrt(counts).sum()
    for _ in range(rounds):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - target)) + 1e-4 * w
        hess = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def _texts(part: pa.RecordBatch) -> Iterator[tuple[str, bool]]:
    """Each text and whether it has a digit."""
    data, offsets = text_bytes(part.column("_text"))
    total = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    for text, n in zip(part.column("_text"), np.diff(total[offsets])):
        yield text.as_py() or "", bool(n)


def count_codes(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How often each combination of kind, votes and size occurs in all texts; there are less than 7 * 3**5 * 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "_text"):
                for text, digits in _texts(part):
                    for *_, code in candidates(text, base_spans(text, digits), digits):
                        seen[code] = seen.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    found = docs.select(F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).mapInArrow(run, "code int, n long")
    return {r["code"]: r["n"] for r in found.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def find(docs: DataFrame, floor: float = 0.5, doc_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """doc_col, the columns in keep, n_email, n_ip, n_card, n_phone, base and spans (each kind:start:end, comma-joined,
    in code points, the end exclusive) per row of docs; with redact also redacted, the text with [KIND] for each span.

    base holds the fixed patterns; spans adds the candidates that the classifier gives at least `floor`. The vote
    statistics it learns from cover all texts. Null and empty texts have no spans and stay as they are; of spans that
    overlap, redaction covers the whole stretch under the first one's kind; repeated rows get equal answers; an empty
    table gives an empty result.
    """
    accepted = frozenset(c for c, p in train(count_codes(docs, text_col)).items() if p >= floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        for batch in batches:
            for part in slices(batch, "_text"):
                counts, base, spans, clean = [], [], [], []
                for (text, digits), raw in zip(_texts(part), part.column("_text")):
                    own = base_spans(text, digits)
                    found = sorted(own + [(a, b, k) for a, b, k, code in candidates(text, own, digits) if code in accepted], key=_place)
                    counts.append([sum(k == x for *_, x in own) for k in BASE])
                    base.append(join(own))
                    spans.append(join(found))
                    if redact:
                        clean.append(_without(text, found) if raw.is_valid else None)
                columns = [part.column("_keep"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(base, pa.string()), pa.array(spans, pa.string())]
                names = ["_keep", *(f"n_{k}" for k in BASE), "base", "spans"]
                if redact:
                    columns, names = [*columns, pa.array(clean, pa.string())], [*names, "redacted"]
                yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select(F.struct(F.col(doc_col), *(F.col(c) for c in keep if c != doc_col)).alias("_keep"), F.col(text_col).alias("_text"))
    added = {**{f"n_{k}": F.lit(0).cast("long") for k in BASE}, "base": F.lit(""), "spans": F.lit("")} | ({"redacted": F.lit(None).cast("string")} if redact else {})
    schema = own.select("_keep").withColumns(added).schema
    return own.mapInArrow(run, schema).select("_keep.*", *added)


def _without(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]
