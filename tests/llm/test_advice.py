"""What the reviewer found missing: unknown languages and junk, very long texts, many languages."""

import base64
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillgraph.llm import kernels, langid, near_dup, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def invented(language, words, seed):
    """A text of words that are built from a language's own syllables."""
    syllables = random.Random(language)
    pool = ["".join(syllables.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)]
    r = random.Random(seed)
    return " ".join("".join(r.choice(pool) for _ in range(r.randrange(1, 4))) for _ in range(words))


def documents(spark, languages, each, more=()):
    rows = [(n * 10_000 + i, invented(f"language {n}", 60, n * 10_000 + i), f"l{n:03}") for n in range(languages) for i in range(each)]
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in [*rows, *more]], COLUMNS)


# ---- language identification


def test_unknown_languages_and_junk_go_however_many_languages_there_are(spark):
    r = random.Random(3)
    junk = {
        -1: "".join(r.choice("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得") for _ in range(150)),
        -2: " ".join(r.choice("и в не на быть он что по это этот мы весь который из свой год".split()) for _ in range(100)),
        -3: " ".join("".join(r.choice("asdfghjklqwertyuiop") for _ in range(r.randrange(3, 10))) for _ in range(60)),
        -4: base64.b64encode(r.randbytes(450)).decode(),
    }
    for languages in (1, 2, 6):
        docs = documents(spark, languages, 60, [(i, t, None) for i, t in junk.items()])
        kept = {x["doc_id"] for x in pipeline.language_id(spark, docs, "").collect()}
        assert not kept & set(junk), (languages, kept & set(junk))
        assert len(kept) == languages * 60


def test_a_very_long_text_keeps_its_language(spark):
    long = [(-1 - n, invented(f"language {n}", 420_000, -1 - n), None) for n in range(3)]
    assert all(len(t) > 2_000_000 for _, t, _ in long)
    docs = documents(spark, 3, 60, long)
    found = {x["doc_id"]: x for x in langid.predict(docs, langid.learn(docs)).where("doc_id < 0").collect()}
    assert [found[-1 - n]["lang_pred"] for n in range(3)] == ["l000", "l001", "l002"]
    assert all(x["score"] > 0.9 and x["known"] for x in found.values())
    assert {x["doc_id"] for x in pipeline.language_id(spark, docs, "").where("doc_id < 0").collect()} == set(found)


def test_stretches_hold_each_gram_once(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 16)
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    texts = [invented("x", 30, 1).encode(), b"", b"ab", invented("y", 9, 2).encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    out, size = np.zeros((4, langid.SLOTS), bool), np.zeros(4, int)
    for text, _, length, p in langid.stretches(data, offsets):
        np.logical_or.at(out, text, p)
        np.add.at(size, text, length)
    assert (out == langid.presence(data, offsets)).all() and size.tolist() == [len(t) for t in texts]


def test_every_language_is_learned(spark):
    docs = documents(spark, 80, 14)
    model = langid.learn(docs)
    assert len(model.languages) == 80
    got = langid.predict(docs, model, keep=("lang",)).where(langid.held_out(F.col("doc_id"))).collect()
    assert {x["lang"] for x in got} > {x["lang"] for x in got[:1]} and np.mean([x["lang"] == x["lang_pred"] for x in got]) > 0.97


def test_workers_give_memory_back_after_each_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(kernels, "give_back", lambda: seen.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "c" * 50])], ["text"])
    assert [p.num_rows for p in kernels.slices(batch, "text", 10)] == [2, 1] and seen == [1]


# ---- near duplicates


def test_pairs_that_meet_only_beside_other_centres_are_linked(spark):
    # A pair shares no shingle but those of the passage that all texts share; unrelated texts align at 0.77.
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randrange(10**8)}" for _ in range(n)]
    shared, rows, group = fresh(150), [], {}
    order = list(range(1, 121))
    r.shuffle(order)
    for a, b in zip(order[::2], order[1::2]):
        own = fresh(45)
        copy = [fresh(1)[0] if i % 5 == 2 else w for i, w in enumerate(own)]
        rows += [(a, " ".join(shared + own)), (b, " ".join(shared + copy))]
        group |= {a: min(a, b), b: min(a, b)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(docs).collect()} == group


def pairs_beside_a_passage(n, seed):
    """(rows, class of each) of n texts in pairs that have no shingle in common but those of a passage that all share."""
    r = random.Random(seed)
    fresh = lambda k: [f"w{r.randrange(10**8)}" for _ in range(k)]
    shared, rows, group = fresh(150), [], {}
    order = list(range(1, n + 1))
    r.shuffle(order)
    for a, b in zip(order[::2], order[1::2]):
        own = fresh(45)
        copy = [fresh(1)[0] if i % 5 == 2 else w for i, w in enumerate(own)]
        rows += [(a, " ".join(shared + own)), (b, " ".join(shared + copy))]
        group |= {a: min(a, b), b: min(a, b)}
    return rows, group


def test_no_pair_of_a_large_sketch_is_lost(spark):
    # Far more texts than centres share the passage.
    rows, group = pairs_beside_a_passage(1000, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(docs).collect()} == group


def test_the_stage_keeps_one_text_of_each_pair_beside_a_passage(spark):
    rows, group = pairs_beside_a_passage(600, 11)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    assert {x["doc_id"] for x in pipeline.near_duplicates(spark, docs, "").collect()} == set(group.values())


def test_words_dealt_out_in_blocks_give_the_same(spark, monkeypatch):
    rows, group = pairs_beside_a_passage(200, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "DEALT", 1)
    assert {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(docs, broadcast_ids=0).collect()} == group


def test_rarest_words_meet_and_parities_are_lower_bounds():
    r = np.random.default_rng(4)
    for _ in range(300):
        a = r.integers(0, 30, r.integers(1, 400)).astype(np.uint64)
        b = a[r.random(len(a)) > r.random() * 0.1]
        b = np.where(r.random(len(b)) < r.random() * 0.15, r.integers(0, 40, len(b)).astype(np.uint64), b)
        if not len(b) or not near_dup.similar(a, b, 0.8):
            continue
        h = near_dup.mix(np.concatenate((a, b)))
        first = np.array([0, len(a), len(h)])
        doc = np.repeat(np.arange(2), np.diff(first))
        tokens = near_dup.occurrence_labelled(h, doc)
        common = r.integers(0, 9, 1 << near_dup.SLOT_BITS)
        at = near_dup.rarest(tokens, doc, first, common, 0.8)
        assert set(tokens[at[doc[at] == 0]]) & set(tokens[at[doc[at] == 1]])
        odd = [near_dup._parity(tokens[lo:hi], p) for lo, hi, p in ((0, len(a), 32), (len(a), len(h), 8))]
        differ = near_dup.changed(np.concatenate(odd).view(np.uint64), np.array([0, 32, 40]), np.array([0, 1]), np.array([1, 1]))
        plain = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in np.bitwise_xor.reduce(odd[0].reshape(4, 8)) ^ odd[1])
        edits = near_dup.edit_distance_within(a, b, len(h))
        assert differ.tolist() == [plain, 0] and plain <= 2 * edits - abs(len(a) - len(b))


def test_pairs_with_few_minima_in_common_are_linked(spark):
    # Every fifth word differs but for the first ones; the pairs share a sketch, and 1 to 3 first minima of 72.
    rows, group = [], {}
    for n, seed in enumerate((18, 50, 56, 158, 230, 234, 236, 274)):
        r = random.Random(seed)
        fresh = lambda k: [f"w{r.randrange(10**8)}" for _ in range(k)]
        own = fresh(150)
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(fresh(1)[0] if i % 5 == 2 and i > 12 else w for i, w in enumerate(own)))]
        group |= {2 * n: 2 * n, 2 * n + 1: 2 * n}
    assert all(edit_similarity(rows[i][1], rows[i + 1][1]) >= 0.8 for i in range(0, len(rows), 2))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    assert {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(docs).collect()} == group
    assert {x["doc_id"] for x in pipeline.near_duplicates(spark, docs, "").collect()} == set(group.values())


def test_a_pair_leaves_by_one_of_its_words(spark, monkeypatch):
    # Ten texts that differ in a word or two have nearly all of their rarest words in common.
    own = [f"w{i}" for i in range(300)]
    rows = [(n, " ".join(f"x{n}" if i == 20 * n else w for i, w in enumerate(own)), n) for n in range(10)]
    rare = near_dup._rare_words(spark.createDataFrame(rows, "id long, text string, label long"), 0.8)
    classes = spark.createDataFrame([], "id long, class long")
    pairs = {(a, b) for a in range(10) for b in range(a)}

    def made():
        return [(max(x["c"], x["m"]), min(x["c"], x["m"])) for x in near_dup._word_rows(rare, classes).mapInArrow(near_dup._met(0.8), near_dup._met_kind(rare)).collect()]

    assert sorted(made()) == sorted(pairs)
    for some in (0, 1, 7):
        monkeypatch.setattr(near_dup, "EARLIER", some)
        again = made()
        assert set(again) == pairs and (some or len(again) > len(pairs))


def word_rows(spark, n, seed):
    rows, group = pairs_beside_a_passage(n, seed)
    rare = near_dup._rare_words(spark.createDataFrame([(i, t, i) for i, t in rows], "id long, text string, label long"), 0.8)
    return rare, near_dup._word_rows(rare, spark.createDataFrame([], "id long, class long")), group


def test_a_text_goes_once_to_each_group_of_words(spark):
    # Rows are bounded by texts and by their words, so that twice the texts are not four times the rows.
    for n in (100, 200, 400):
        rare, rows, _ = word_rows(spark, n, 12)
        words = sum(len(x["w"]) for x in rare.collect())
        assert words > 25 * n and rows.count() <= min(16 * n, words)


def test_groups_of_words_give_the_pairs_of_brute_force(spark, monkeypatch):
    for dealt in (4000, 1):
        monkeypatch.setattr(near_dup, "DEALT", dealt)
        rare, _, group = word_rows(spark, 60, 13)
        texts, want = rare.collect(), set()
        for k, x in enumerate(texts):
            for y in texts[:k]:
                edits, odd = int(0.2 * max(x["size"], y["size"]) + 1e-9), [np.array(v["odd"]).view(np.uint64) for v in (x, y)]
                differ = near_dup.changed(np.concatenate(odd), np.array([0, len(odd[0]), len(odd[0]) + len(odd[1])]), np.array([0]), np.array([1]))[0]
                if set(x["w"]) & set(y["w"]) and differ <= 2 * edits - abs(x["size"] - y["size"]):
                    want.add((min(x["text_id"], y["text_id"]), max(x["text_id"], y["text_id"])))
        assert want >= {(c, i) for i, c in group.items() if c < i}
        for grouped, earlier, at_once in ((30_000, 128, 50_000), (1, 128, 7), (300, 3, 100), (300, 0, 100)):
            monkeypatch.setattr(near_dup, "GROUPED", grouped)
            monkeypatch.setattr(near_dup, "EARLIER", earlier)
            monkeypatch.setattr(near_dup, "GROUPED_AT_ONCE", at_once)
            rows = near_dup._word_rows(rare, spark.createDataFrame([], "id long, class long"))
            left = [(min(x["c"], x["m"]), max(x["c"], x["m"])) for x in rows.mapInArrow(near_dup._met(0.8), near_dup._met_kind(rare)).collect()]
            assert set(left) == want and (earlier < 128 or len(left) == len(want))


def test_rows_with_a_word_in_common(monkeypatch):
    r = np.random.default_rng(5)
    lists = [r.integers(-9, 9, r.integers(0, 5)).astype(np.int32) for _ in range(60)]
    first = np.append(0, np.cumsum([len(x) for x in lists]))
    a, b = r.integers(0, 60, 500), r.integers(0, 60, 500)
    monkeypatch.setattr(near_dup, "WORDS_AT_ONCE", 50)
    assert near_dup.met_earlier(np.concatenate(lists), first, a, b).tolist() == [bool(set(lists[x]) & set(lists[y])) for x, y in zip(a, b)]


def substituted(text, share, seed):
    """The text with a share of its words, at random places, changed."""
    r = random.Random(seed)
    w = text.split()
    for i in r.sample(range(len(w)), round(len(w) * share)):
        w[i] = f"new{r.randrange(10**9)}"
    return " ".join(w)


def edit_similarity(a, b):
    """1 - edit distance / words of the longer, by the plain table."""
    a, b = a.split(), b.split()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_pairs_at_the_threshold_are_found(spark):
    # All pairs are held against each other by the plain table of edit distances, unless they have too few words in common.
    texts, rate = {}, {}
    for n, share in enumerate((0.1, 0.15, 0.2)):
        for i in range(80):
            a = 1000 * n + 2 * i
            texts[a] = " ".join(f"w{x}" for x in random.Random(a).choices(range(10**6), k=50 + 2 * i))
            texts[a + 1] = substituted(texts[a], share, a)
            rate[a, a + 1] = share
    bags = {i: set(t.split()) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and len(bags[a] & bags[b]) >= 0.8 * max(len(bags[a]), len(bags[b])) - 1 and edit_similarity(texts[a], texts[b]) >= 0.8]
    assert set(links) <= set(rate) and len(links) > 200
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(docs).collect()}
    for share, least in ((0.1, 0.99), (0.15, 0.97), (0.2, 0.9)):
        own = [p for p in links if rate[p] == share]
        found = sum(got[a] == got[b] for a, b in own) / len(own)
        assert found >= least, (share, found)
    pairs = {frozenset(p) for p in links}
    assert all(c == i or frozenset((c, i)) in pairs for i, c in got.items())


def test_long_texts_and_clashing_columns(spark):
    long = invented("long", 60_000, 1)
    rows = [(1, long), (2, substituted(long, 0.05, 2)), (3, invented("other", 60_000, 3)), (4, "x"), (5, "x")]
    docs = spark.createDataFrame([(i, t, i, t, "k") for i, t in rows], "doc_id long, text string, id long, sha string, key string")
    assert {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


# ---- personal data


def test_long_secrets_are_candidates(spark):
    r = random.Random(4)
    token = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    late = "".join(r.choice("abcdefghijk") for _ in range(70)) + "7" + token(20)
    long = [token(129), token(5000), late]
    texts = [f'token = "{t}"' for t in [*long, *(token(40) for _ in range(30))]] + ["plain words of no interest"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), redact=True).where("doc_id < 3").collect()
    assert [x["redacted"] for x in found] == ['token = "[SECRET]"'] * 3
    assert [x["spans"] for x in found] == [f"secret:9:{9 + len(t)}" for t in long]
    assert not pii.candidates("a" * 200_000, [], True)


# ---- the pipeline's rows


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    item, other = invented("item", 40, 1), invented("other", 60, 2)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [invented("clean", 60, i) for i in range(3)]
    rows = [(None, item), (None, clean[0]), (5, item), (5, clean[1]), (6, clean[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    left = pipeline.benchmark_passages(spark, docs, str(tmp_path)).collect()
    assert sorted((x["doc_id"] or -1, x["text"]) for x in left) == sorted([(-1, clean[0]), (5, clean[1]), (6, clean[2])])
    rows = [(7, clean[0], "b"), (7, clean[0] + " more", "a"), (7, other, "a"), (8, clean[1], "b"), (8, clean[1], "a"), (9, other, "a"), (None, other, "a")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], COLUMNS)
    left = [(x["doc_id"], x["text"], x["lang"]) for x in pipeline.near_duplicates(spark, docs, "").collect()]
    assert {(i, t) for i, t, _ in left} in ({(7, c), (7, other), (8, clean[1]), (None, other)} for c in (clean[0], clean[0] + " more"))
    assert len(left) == 4 and (8, clean[1], "a") in left
