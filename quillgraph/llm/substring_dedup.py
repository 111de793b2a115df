"""Substring dedup: passages that an earlier document holds are found by FM-indexes, one per shard of like passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.fm_index import FMIndex
from quillgraph.llm.kernels import _BASE, U, mix, powers, rolling, sliding_min, slices, text_bytes, word_hashes, words
from quillgraph.llm.store import cut_lineage, stored

#: Words of the grams whose least hash names a window's shard key.
GRAM = 10
#: Words of an index; different stretches of one key that are indexed together, more being compared by window hash.
SHARD_WORDS, KEY_STRETCHES = 600_000, 1_000
#: (doc_id, hash) pairs (16 bytes each) up to this number are broadcast to pick out texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
LAST = (1 << 63) - 1
_INVERSE = pow(int(_BASE), -1, 1 << 64)


def stretch_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each stretch h[lo:hi], from running sums of a polynomial modulo 2**64."""
    p = powers(len(h) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(h) * p[: len(h)], dtype=U)))
    back = np.full(len(h) + 1, _INVERSE, U)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mix((total[hi] - total[lo]) * back[lo] + (hi - lo).astype(U))


def stretches(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, key, hash, start, last): runs of neighbouring windows of a text that have the same least gram hash, the key,
    with the hash of all their words and the first and last window's start within the text."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none.astype(U), none.astype(U), none, none
    least = sliding_min(rolling(h, gram), window - gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: len(least)] == text[window - 1 :])
    if not len(at):
        return none, none.astype(U), none.astype(U), none, none
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
    lo, hi = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    own = text[lo]
    return own, least[lo], stretch_hashes(h, lo, hi + window), lo - first[own], hi - first[own]


def _kept(text: bytes, removed: np.ndarray | None = None) -> tuple[int, str]:
    """Number of words removed, and the digest of the others."""
    own = text.split()
    if removed is not None:
        own = [w for w, gone in zip(own, removed) if not gone]
    return 0 if removed is None else int(removed.sum()), hashlib.sha256(b" ".join(own)).hexdigest()


def _scan(window: int, gram: int):
    """Per text a row with its number of words and digest, and one for each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, first = words(data, offsets)
                own, key, seg, a, b = stretches(word_hashes(data, starts, ends), first, window, gram)
                rows = pa.array(np.concatenate((np.arange(part.num_rows), own)))
                n = part.num_rows
                body = data.tobytes()
                sha = [_kept(body[lo:hi])[1] for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                head = np.arange(n + len(own)) < n
                both = lambda x, y, kind: pa.array(np.concatenate((x, y.astype(np.int64))), kind)
                zero = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(rows), part.column("th").take(rows), pa.array(np.concatenate((zero, key.view(np.int64))), pa.int64(), mask=head), both(zero, seg.view(np.int64), pa.int64()), both(np.diff(first), a, pa.int32()), both(zero, b, pa.int32()), pa.array(sha + [None] * len(own), pa.string())],
                    ["id", "th", "key", "seg", "a", "b", "sha"],
                )

    return run


def _passages(window: int):
    """Words (as hashes) of the stretches listed with a text; of those of hot keys the hashes of their windows instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, first = words(data, offsets)
                h = word_hashes(data, starts, ends)
                out: list[tuple] = []
                for i, (ident, listed) in enumerate(zip(part.column("id").to_pylist(), part.column("list").to_pylist())):
                    own = h[first[i] : first[i + 1]]
                    for x in listed:
                        piece = own[x["a"] : x["b"] + window]
                        if x["hot"]:
                            lo = np.arange(len(piece) - window + 1)
                            piece = np.stack((stretch_hashes(piece, lo, lo + window), stretch_hashes(~piece, lo, lo + window)), 1).reshape(-1)
                        out.append((x["key"], x["seg"], ident, x["hot"], piece.tobytes()))
                cols = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["key", "seg", "id", "hot", "words"])

    return run


def _indexed(window: int):
    """Per stretch of a shard, the windows (by their place in it) that a smaller document of the shard holds."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(w, U) for w in table.column("words").to_pylist()]
        doc = table.column("id").to_numpy().astype(np.int64)
        first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        tokens = np.concatenate(parts)
        _, least = FMIndex(tokens, first, doc, window).statistics(tokens, first)
        owner = np.repeat(np.arange(len(parts)), np.diff(first))
        hit = np.flatnonzero((least >= 0) & (least < doc[owner]))
        # Neighbouring windows of one stretch become one run.
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])
        lo, hi = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
        own = pa.array(owner[lo])
        return pa.table({"key": table.column("key").take(own), "seg": table.column("seg").take(own), "lo": pa.array(lo - first[owner[lo]], pa.int32()), "hi": pa.array(hi - first[owner[lo]], pa.int32())})

    return run


def _cleaned(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                body = data.tobytes()
                count, sha, text = [], [], []
                for lo, hi, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("spans").to_pylist()):
                    own = body[lo:hi].split()
                    gone = np.zeros(len(own), bool)
                    for s in spans:
                        gone[s["s"] : s["e"]] = True
                    left = b" ".join([w for w, g in zip(own, gone.tolist()) if not g])
                    count.append(int(gone.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    text.append(left.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], ["id", "th", "n", "sha2", "kept"])

    return run


def _picked(own: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The texts whose (id, th) are in `ids`, joined to its other columns."""
    keys = ids.select("id", "th")
    texts = own
    if keys.limit(limit + 1).count() <= limit:
        texts = own.join(F.broadcast(keys), ["id", "th"], "left_semi")
    return texts.join(ids, ["id", "th"])


def removed_passages(docs: DataFrame, window: int = 50, doc_col: str = "doc_id", text_col: str = "text", with_text: bool = False, gram: int = GRAM, shard_words: int = SHARD_WORDS, key_stretches: int = KEY_STRETCHES, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_col, n_words, n_removed, kept_sha256 per row of docs: each word is removed that lies in `window` consecutive
    words which also start in a document of smaller id. with_text adds kept_text, the words that stay, joined by a space,
    null where all do.

    Windows that share a least gram hash, neighbours in the text mostly, go to the same shard as one stretch, so equal
    windows meet whatever surrounds them. Only keys that several documents have go on, equal stretches as one, with
    their smallest document. Each shard builds an FM-index of its stretches and streams them through it: backward search
    gives for each position the match length, cut at `window`, and the least document with that window. A key with more
    than key_stretches different stretches would swell one shard: its windows are dealt out by their own 128-bit hash and
    compared by smallest document instead, with the same result.

    Null and empty texts have no words. Rows that repeat an id remove nothing from each other, and repeated rows give
    repeated rows. A null id is larger than all others. An empty table gives an empty result.
    """
    own = docs.select(F.coalesce(F.col(doc_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    seen = stored(own.mapInArrow(_scan(window, gram), "id long, th long, key long, seg long, a int, b int, sha string"), "stretches")
    heads, runs = seen.where("key is null"), seen.where("key is not null").drop("sha")

    shared = cut_lineage(runs.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"))
    runs = cut_lineage(runs.join(shared, "key"))
    same = cut_lineage(runs.groupBy("key", "seg").agg(F.min(F.struct("id", "th", "a", "b")).alias("m"), F.max("id").alias("hi")))
    kinds = cut_lineage(same.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    mixed = same.join(kinds, "key").select("m.id", "m.th", F.struct("key", "seg", "m.a", "m.b", (F.col("n") > key_stretches).alias("hot")).alias("x"))
    total = mixed.agg(F.sum(F.col("x.b") - F.col("x.a") + window)).first()[0] or 0
    shards = -(-total // shard_words) or 1
    listed = cut_lineage(mixed.groupBy("id", "th").agg(F.collect_list("x").alias("list")))
    texts = _picked(own, listed, broadcast_ids).dropDuplicates(["id", "th"])
    passages = cut_lineage(texts.select("id", "text", "list").mapInArrow(_passages(window), "key long, seg long, id long, hot boolean, words binary"))

    cold = passages.where(~F.col("hot")).select("key", "seg", "id", "words", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    found = cold.groupBy("shard").applyInArrow(_indexed(window), "key long, seg long, lo int, hi int")
    at = F.sequence(F.lit(0), (F.length("words") / 16 - 1).cast("int"))
    hot = passages.where("hot").select("key", "seg", "id", "words", F.explode(at).alias("lo")).select("key", "seg", "id", "lo", F.substring(F.col("words"), F.col("lo") * 16 + 1, F.lit(16)).alias("w"))
    least = cut_lineage(hot.groupBy("w").agg(F.min("id").alias("first")))
    more = hot.join(least, "w").where("first < id").select("key", "seg", "lo", F.col("lo").alias("hi"))
    found = found.unionByName(more).groupBy("key", "seg").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    # What each document loses: all of a stretch that a smaller document has, else the runs found in it.
    known = cut_lineage(same.select("key", "seg", F.col("m.id").alias("first"), "hi").join(found, ["key", "seg"], "left").where("hi > first or runs is not null").drop("hi"))
    lost = runs.join(known, ["key", "seg"])
    whole = F.array(F.struct(F.col("a").alias("s"), (F.col("b") + window).alias("e")))
    some = F.transform(F.coalesce("runs", F.array().cast("array<struct<lo:int,hi:int>>")), lambda r: F.struct((F.col("a") + r["lo"]).alias("s"), (F.col("a") + r["hi"] + window).alias("e")))
    spans = lost.select("id", "th", F.explode(F.when(F.col("id") > F.col("first"), whole).otherwise(some)).alias("x"))
    spans = cut_lineage(spans.groupBy("id", "th").agg(F.collect_list("x").alias("spans")))
    cleaned = _picked(own, spans, broadcast_ids).select("id", "th", "text", "spans").mapInArrow(_cleaned(with_text), "id long, th long, n long, sha2 string, kept string").dropDuplicates(["id", "th"])
    out = heads.join(cleaned, ["id", "th"], "left")
    columns = [F.when(F.col("id") != LAST, F.col("id")).alias(doc_col), F.col("a").cast("long").alias("n_words"), F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha2", "sha").alias("kept_sha256")]
    return out.select(*columns, *([F.col("kept").alias("kept_text")] if with_text else []))
