"""Operators with array kernels against brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import langid, near_dup, neighbours, pii, substring_dedup, token_count, warc
from quillgraph.llm.fm_index import FMIndex
from quillgraph.llm.store import fresh_dir

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 8))) for _ in range(n))


# ---- substring dedup


def brute_passages(rows, window):
    first = {}
    for i, t in sorted(((r[0] if r[0] is not None else 1 << 70), r[1]) for r in rows if r[1]):
        w = SPACE.findall(t)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i if i is not None else 1 << 70):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()))
    return out


def passages():
    a, b, c = text_of(120, 1), text_of(60, 2), text_of(300, 3)
    rows = [(5, a), (3, b + " " + a), (9, c), (10, c), (11, c.replace(" ", "  ", 1)), (12, text_of(20, 4) + "\n" + b + "\t" + text_of(30, 5)), (13, None), (14, ""), (15, "x " * 500), (16, "x " * 80), (17, "a b"), (3, c), (3, b + " " + a), (None, a)]
    hot = text_of(70, 6)
    return rows + [(100 + i, text_of(30, 100 + i) + " " + hot + " " + text_of(25, 200 + i)) for i in range(30)]


@pytest.mark.parametrize("options", [{}, {"key_stretches": 1}, {"shard_words": 300, "broadcast_ids": 0}, {"window": 12, "gram": 5}])
def test_removed_passages_equal_brute_force(spark, options):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("key", F.lit(1))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = substring_dedup.removed_passages(df, **options).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_passages(rows, options.get("window", 50)), key=key)


def test_removed_passages_of_an_empty_table(spark):
    assert substring_dedup.removed_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_matching_statistics_equal_brute_force():
    r = random.Random(3)
    for _ in range(40):
        window, sigma = r.choice([2, 3, 5, 8]), r.choice([2, 4, 10])
        texts = [[r.randrange(sigma) for _ in range(r.randrange(1, 25))] for _ in range(r.randrange(1, 6))]
        doc = np.array([r.randrange(9) for _ in texts])
        flat = lambda xs: (np.array(sum(xs, []), np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in xs]))))
        index = FMIndex(*flat(texts), doc, window)
        asked = [[r.randrange(sigma + 1) for _ in range(r.randrange(0, 15))] for _ in range(4)] + texts[:1]
        tokens, first = flat(asked)
        length, least = index.statistics(tokens, first)
        holds = defaultdict(lambda: 99)
        for t, d in zip(texts, doc):
            for i in range(len(t)):
                for k in range(1, min(window, len(t) - i) + 1):
                    holds[tuple(t[i : i + k])] = min(holds[tuple(t[i : i + k])], d)
        for j, t in enumerate(asked):
            for i in range(len(t)):
                k = max((k for k in range(0, min(window, len(t) - i) + 1) if k == 0 or tuple(t[i : i + k]) in holds), default=0)
                assert length[first[j] + i] == k
                assert least[first[j] + i] == (holds[tuple(t[i : i + k])] if k == window else -1)


# ---- language identification


def test_languages_are_told_apart(spark):
    pools = {"aa": "the of and to in is".split(), "bb": "der die und nicht für schön".split(), "cc": "le la été où ça et".split()}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(pools[k]) for _ in range(r.randrange(5, 60))), k if i % 10 else None, "x") for i in range(600) for k in [list(pools)[i % 3]]]
    rows += [(9001, None, "aa", "x"), (9002, "", None, "x"), (9003, "123 456 !!", "bb", "x"), (9004, "der die " * 20000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {x["doc_id"]: x for x in langid.predict(df, langid.learn(df)).collect()}
    own = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == list(pools)[i % 3] for i in own]) > 0.97
    assert [got[i]["lang_pred"] for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "bb"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.learn(df.where("lang is null")) is None
    assert {x["lang_pred"] for x in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), langid.learn(df)).count() == 0


def test_presence_is_the_same_in_pieces(monkeypatch):
    texts = [b"", b"a", b"ab", b"The cat", text_of(300, 1).encode(), b"xyz" * 40]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = langid.presence(data, offsets)
    alone = [langid.presence(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    monkeypatch.setattr(langid, "PIECE", 17)
    assert (langid.presence(data, offsets) == whole).all() and (np.stack(alone) == whole).all()
    assert whole[0].sum() == 0 and whole[2].sum() == 1 and whole[3].sum() == 6 + 5 + 4


def test_held_out_follows_crc32(spark):
    df = spark.range(50).select(langid.held_out(F.col("id")).alias("h"), "id")
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in df.collect())


# ---- token counts


def brute_pieces(word, vocabulary, prefix):
    data, at, n, most = prefix + word, 0, 0, max(map(len, vocabulary))
    while at < len(data):
        k = next((k for k in range(min(most, len(data) - at), 0, -1) if data[at : at + k] in vocabulary), 0)
        if not k:
            return 1
        at, n = at + k, n + 1
    return n


def test_token_counts_equal_greedy_longest_match(spark):
    r = random.Random(2)
    vocabulary = [b" ", b" a", b"a", b"b", b"ab", b"abab", b"bb", b"ba", b"cc", b" abc", b"\xc3\xa9", b"abcx"]
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(0, 30))) for _ in range(60)] + [None, "", "  \n", "ab" * 50_000, "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("x"))
    known = set(vocabulary)
    for x in token_count.token_counts(df, vocabulary).collect():
        own = [w.encode() for w in SPACE.findall(texts[x["doc_id"]] or "")]
        want = sum(brute_pieces(w, known, b" ") for w in own)
        assert (x["n_words"], x["n_tokens"]) == (len(own), want)
        assert x["doc_id"] != 63 or want == 50_001
    assert token_count.token_counts(df.limit(0), vocabulary).count() == 0


def test_automaton_over_random_vocabularies():
    r = random.Random(4)
    for _ in range(60):
        vocabulary = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 25))} | ({b"a", b"b", b"c"} if r.random() < 0.7 else set())
        own = [bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 14))) for _ in range(40)]
        ends = np.cumsum([len(w) for w in own])
        got = token_count.Automaton(sorted(vocabulary)).counts(np.frombuffer(b"".join(own), np.uint8), ends - [len(w) for w in own], ends, b"")
        assert got.tolist() == [brute_pieces(w, vocabulary, b"") for w in own]


# ---- nearest neighbours


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            near = sorted((-(q @ v) / (np.sqrt(q @ q) * np.sqrt(v @ v)), j) for j, v in ok if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_nearest_neighbours(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.standard_normal(8).round(3).tolist()) for i in range(1500)]
    same = rows[50][1]
    rows += [(i, same) for i in range(1500, 1700)]
    rows += [(1700, None), (1750, [0.0] * 8), (1800, [float("nan")] + [1.0] * 7), (1801, [None] + [1.0] * 7), (1850, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int".replace(", label int", "")).withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    got = defaultdict(list)
    for x in neighbours.search(df, F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"], x["rank"]))
    want = brute_nearest(rows, 5)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        assert [x[2] for x in got[q]] == [1, 2, 3, 4, 5]
        assert q not in [x[0] for x in got[q]]
        hits += len({j for j, _ in near} & {x[0] for x in got[q]})
        exact = dict(near)
        assert all(x[1] == pytest.approx(exact[x[0]], abs=1e-12) for x in got[q] if x[0] in exact)
    assert hits / (5 * len(want)) >= 0.9
    assert [x[0] for x in got[1550]] == [50, 1500, 1501, 1502, 1503]


def test_few_vectors_give_all(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    assert [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"])] == [(0, 1, 2, 0.0), (0, 2, 1, -1.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "http://d", ""), (5, "u\r\nX: 1", "é" * 100_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (2, "again", "x"), (None, "n", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))
    got = {(x["page_id"], x["record_type"]): x for x in warc.round_trip(df, fresh_dir(spark, "t")).collect()}
    body = lambda t: (t or "").encode()
    for p, _, html in rows:
        x = next(v for k, v in got.items() if k[0] == p)
        assert x["payload_bytes"] == len(body(html)) and x["payload_digest"] == warc.sha1_base32(body(html))
    kinds = {k: v["refers_to"] for k, v in got.items()}
    assert kinds == {(1, "revisit"): 2, (2, "response"): None, (3, "revisit"): 4, (4, "response"): None, (5, "response"): None, (6, "response"): None, (None, "revisit"): 2}
    assert warc.round_trip(df, fresh_dir(spark, "t")).count() == len(rows)
    assert warc.round_trip(df.limit(0), fresh_dir(spark, "t")).count() == 0
    assert warc.round_trip(df, fresh_dir(spark, "t"), revisit_bytes=2).where("record_type = 'revisit'").count() == 0


def test_payloads_come_back(spark):
    df = spark.createDataFrame([(i, "u", text_of(i * 20, i)) for i in range(30)], "page_id long, url string, html string")
    paths = warc.write_archives(warc.plan_records(df), fresh_dir(spark, "t")).select("path")
    back = {x["page_id"]: bytes(x["payload"]).decode() for x in warc.read_archives(spark.createDataFrame(paths.collect(), "path string"), payloads=True).collect()}
    assert back == {i: text_of(i * 20, i) for i in range(30)}


def test_broken_archives_are_told(tmp_path):
    good = warc.record("response", "u", "<urn:page:1>", b"hello", warc.sha1_base32(b"hello"), None, "2000-01-01T00:00:00Z")
    assert list(warc.members(iter([good[:10], good[10:], good]))) == [zlib.decompress(good, 31)] * 2
    with pytest.raises(warc.BrokenArchive):
        list(warc.members(iter([good, good[:-20]])))
    with pytest.raises(warc.BrokenArchive):
        warc.parse(zlib.decompress(good, 31).replace(b"hello", b"jello"))
    with pytest.raises(warc.BrokenArchive):
        warc.parse(zlib.decompress(good, 31)[:-6])


# ---- near duplicates


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_banded_alignment_is_exact():
    r = random.Random(1)
    for _ in range(600):
        a = [r.randrange(5) for _ in range(r.randrange(0, 22))]
        b = list(a) if r.random() < 0.8 else [r.randrange(5) for _ in range(r.randrange(0, 22))]
        for _ in range(r.randrange(0, 7)):
            if b and r.random() < 0.5:
                b[r.randrange(len(b))] = r.randrange(5)
            else:
                b.insert(r.randrange(len(b) + 1), r.randrange(5))
        limit = r.randrange(0, 14)
        e = edits(a, b)
        assert near_dup.edit_distance_within(np.array(a, np.uint64), np.array(b, np.uint64), limit) == (e if e <= limit else None)


def changed(text, share, seed):
    r = random.Random(seed)
    w = text.split()
    for i in r.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_share_a_class_and_others_do_not(spark):
    rows, group = [], {}
    for g in range(60):
        base = text_of(80 + g * 5, 1000 + g)
        for c in range(3):
            rows.append((g * 10 + c + 1, changed(base, 0.015, g * 7 + c) if c else base))
            group[g * 10 + c + 1] = g * 10 + 1
    base = text_of(150, 5)
    rows += [(5000 + i, changed(base, 0.02, i)) for i in range(200)]
    group |= {5000 + i: 5000 for i in range(200)}
    w = text_of(200, 6).split()
    rows += [(7000, " ".join(w)), (7001, " ".join(w[100:] + w[:100])), (7002, None), (7003, None), (7004, ""), (7005, "a b"), (7006, "a b"), (7007, "a c"), (None, "a b"), (7005, "a b")]
    group |= {7000: 7000, 7001: 7001, 7002: 7002, 7003: 7002, 7004: 7004, 7005: 7005, 7006: 7005, 7007: 7007}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("class", F.lit(2))
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(group)
    assert {x["doc_id"]: x["class_id"] for x in got} == group
    assert near_dup.near_duplicates(df, broadcast_ids=0).select("doc_id", "class_id").exceptAll(spark.createDataFrame(list(group.items()), "a long, b long")).count() == 0
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_files_of_rounds_that_are_over_are_deleted(spark):
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.iterdir())
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    found = near_dup.components(chain)
    assert len(set(folder.iterdir()) - before) == 1
    assert {tuple(x) for x in found.collect()} == {(i, 0) for i in range(41)}


def test_components(spark):
    r = random.Random(0)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["id"]: x["class"] for x in near_dup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]} | {x: find(x) for x in got}


# ---- personal data



def luhn(digits):
    """The check of card numbers, by its book: from the right, every second digit doubled and its digits summed."""
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(sum(map(int, str(x))) for x in doubled) % 10 == 0


BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
}


def brute_base(text):
    return sorted(((m.start(), m.end(), k) for k, (p, ok) in BASE.items() for m in p.finditer(text) if ok(m[0])), key=lambda x: (x[0], list(BASE).index(x[2])))


def test_base_patterns_equal_plain_regular_expressions():
    r = random.Random(5)
    parts = ["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "999", "255.255.255.255", "+1 (212) 555-0100", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "x", " ", "-", "é", "12", "\n", "%", "a.b@c-d.e.f"]
    assert pii.base_spans("0" * 9000 + "1.2.3.0004") == [(0, 9010, "ip")]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(0, 14)))
        assert pii.base_spans(t) == brute_base(t), t


def test_personal_data_of_documents(spark):
    texts = [None, "", "mail a@b.org or +1 212 555 0100", 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', "Call (743) 555-3824 now", "Dear Dr Jane Wilson,", "1" * 200_000, "a" * 200_000, "plain words only", "é a@b.org"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").withColumn("base", F.lit(1))
    got = {x["doc_id"]: x for x in pii.find(df, redact=True).collect()}
    assert len(got) == 3 * len(texts)
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for a, b, k in brute_base(t or "")) if t is None or len(t) < 10_000 else ""
        assert got[i]["base"] == want
        assert set(want.split(",")) <= set(got[i]["spans"].split(",")) | {""}
    assert got[2]["redacted"] == "mail [EMAIL] or [PHONE]" and got[0]["redacted"] is None and got[8]["redacted"] == texts[8]
    assert got[3]["spans"].startswith("secret:") and got[4]["spans"].startswith("phone:")
    assert pii.find(df.limit(0)).count() == 0


def test_em_finds_the_labelers_that_lie():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.4
    cols = [np.where(r.random(20_000) < right, truth, ~truth) * 2 - 1 for right in (0.9, 0.85, 0.8, 0.5)]
    patterns, counts = np.unique(np.stack(cols, 1), axis=0, return_counts=True)
    p, table = pii.reliabilities(patterns, counts.astype(float))
    right = table[:, 1, 2]
    assert right[0] > right[1] > right[2] > right[3] and abs(right[0] - 0.9) < 0.04 and abs(right[3] - 0.5) < 0.04
