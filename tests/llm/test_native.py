"""Decontamination, license scan and mixing against brute force, with the cases that the docstrings name."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, license_scan, mixing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, fp string, slot int, _w string, size int, source string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def passage(n, seed=0):
    return " ".join(f"w{(i * 7 + seed * 131) % 97}x{i + seed * 1000}" for i in range(n))


BENCH = [(1, passage(30, 1)), (2, passage(13, 2)), (3, "One Two"), (4, None), (5, ""), (10, passage(30, 1)), (6, "solo"), (7, passage(60, 3) + " " + passage(20, 1))]
TEXTS = [
    "nothing here", None, "", "!!!", f"start {passage(30, 1).upper()} end", passage(12, 2), f"a, {passage(13, 2)}; b", "x one two y one  two", "SOLO", passage(40, 3) + " É " + passage(15, 1), passage(60, 3).replace(" ", "\n"),
    "aaa " * 400, " ".join([passage(13, 2)] * 5), passage(6000, 9) + " " + passage(30, 1), passage(30, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "f", i, "w", 1, None) for i, t in enumerate(TEXTS)] + [(14, passage(30, 1), "f", 1, "w", 1, None), (None, passage(13, 2), "f", 1, "w", 1, None)]
    return spark.createDataFrame(rows, DOCS)


def brute_hits(text, bench, window=13):
    w, hit, items = words(text), set(), set()
    for item, body in bench:
        b = words(body)
        k = min(window, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                items.add(str(item))
    return len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_decontamination_equals_brute_force(spark, docs, broadcast_rows):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contaminated(docs, bench, broadcast_rows=broadcast_rows).collect()
    want = [(r["doc_id"], *brute_hits(r["text"], BENCH)) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got], key=key) == sorted(want, key=key)


def test_decontamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contaminated(docs, none).count() == docs.count()
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame(BENCH, none.schema)).count() == 0


LICENSED = [
    "CC-BY and cc by", None, "", "the GNU General Public License, v3. All rights reserved.", "general public", "cc by by cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "Permission is hereby granted, free of any charge, to each person obtaining copy of this software and associated documentation files", "word " * 3000 + "all rights reserved", "all rights  reserved all rights reserved",
    # A text that drifts word by word, one whose halves trade places, one that repeats its grams, and a notice pulled apart.
    "permission x is hereby granted y free of charge to z any person obtaining a copy u of this software and associated v documentation files",
    "obtaining a copy of this software and associated documentation files permission is hereby granted free of charge to any person",
    "this is free and this is free and this is free and this is free and this is free and this is free", " filler".join("this is free and unencumbered software released into the public domain".split()), "this is free and unencumbered software released into the public domain " * 40,
]


def brute_licenses(text):
    w = words(text)
    spots = [(i, label) for p, label in license_scan.PHRASES.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if w[i : i + n] == p.split()]
    labels, score = {label for _, label in spots}, 1.0 if spots else 0.0
    for p, label in license_scan.NOTICES.items():
        t = p.split()
        found = sorted((i - j, j, i) for i in range(len(w) - 2) for j in range(len(t) - 2) if w[i : i + 3] == t[j : j + 3])
        chains = []
        for x in found:
            if not chains or x[0] - chains[-1][-1][0] > 2:
                chains.append([])
            chains[-1].append(x)
        for chain in chains:
            first = {j: min(i for _, j2, i in chain if j2 == j) for _, j, _ in chain}
            spots_in_order = [i for j, i in sorted(first.items()) if all(i > first[j2] for j2 in first if j2 < j)]
            if len(spots_in_order) >= 0.6 * (len(t) - 2) and spots_in_order[-1] - spots_in_order[0] < 2 * len(t):
                labels.add(label)
                score = max(score, len(spots_in_order) / (len(t) - 2))
    at = [i for i, _ in spots]
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in spots}), sorted(labels), pytest.approx(score)


def test_license_scan_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(LICENSED)] + [(0, LICENSED[0], 1, "x")], "doc_id long, text string, tid int, label string")
    got = license_scan.scan(df).collect()
    assert len(got) == len(LICENSED) + 1
    for r in got:
        assert tuple(r)[1:] == brute_licenses(LICENSED[r["doc_id"]])
    assert license_scan.scan(df.limit(0)).count() == 0


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_reaches_the_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), ["a", "b", "é", "Z", None][i * i % 5 if i % 3 else 0], i) for i in range(400)] + [(7, None, "b", 1), (8, "", "empty", 1), (9, "x", "a", 2), (9, "x", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.taken_by_document(df, keep=("source",), run_digits=1).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= len(want) for s in want) and sum(taken.values()) == int(1.5 * sum(sizes.values()))
    again = mixing.taken_by_document(df.repartition(3), keep=("source",), run_digits=1).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def brute_mix(rows, weights=(3, 1, 2)):
    """Taken words of each row (doc_id, text, source), by one walk over all pieces in the order of their finish."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    goal, pieces, budget = targets(sizes, weights), [], int(1.5 * sum(sizes.values()))
    for source in sizes:
        own = sorted((hashlib.md5("\x01".join(["17", str(i), t or ""]).encode()).hexdigest(), n) for n, (i, t, s) in enumerate(rows) if s == source)
        at = 0
        for copy in (0, 1):
            for h, n in own:
                size, edge = len((rows[n][1] or "").split()), int(goal[source])
                cuts = [at, edge, at + size] if at < edge < at + size else [at, at + size]
                pieces += [(b / goal[source], source, copy, h, n, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]
                at += size
    taken = Counter()
    for *_, n, size in sorted(pieces):
        taken[n] += min(size, budget)
        budget -= min(size, budget)
    return [taken[n] for n in range(len(rows))]


def test_the_mix_equals_a_walk_in_order_of_finish(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.choice([1, 5, 40, 300]), r.choice("aaaabcd")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 7):
        got = {x["doc_id"]: x["taken"] for x in mixing.taken_by_document(df.repartition(n)).collect()}
        assert [got[i] for i in range(300)] == brute_mix(rows)


def test_the_mix_is_in_order_of_finish_and_within_budget(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    assert sum(r["taken"] for r in got if r["start"] >= 1) <= 3
    total = sum(i % 9 + 1 for i in range(90))
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 3
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.taken_by_document(df.withColumn("text", F.lit(None).cast("string"))).where("taken > 0").count() == 0
