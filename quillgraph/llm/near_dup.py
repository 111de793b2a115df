"""Near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.kernels import U, mix, powers, rolling, slices, text_bytes, word_hashes, words
from quillgraph.llm.store import cut_lineage, release, sweep

#: Words of a shingle, similarity, sketches of a text, and shingles that a sketch keeps in their order.
SHINGLE, SIMILARITY, SKETCHES, KEPT = 5, 0.8, 72, 2
#: Ids (8 bytes each) up to this number are broadcast to pick out texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Texts that are aligned to one copy of a centre.
FAN = 64
#: Centres of a sketch whose texts are of several classes, and texts of a sketch whose pairs are listed one by one; texts of
#: larger ones are looked up by their rarest words.
CENTRES, SMALL = 4, 64
#: Slots that words are counted in to tell the rare ones, as a power of two, and texts of a word that are held against each other at once.
SLOT_BITS, DEALT = 19, 4000
#: Most numbers of parities that go with a word of a text, for texts of a thousand words and more: four buckets or more a word in shorter ones.
WIDEST = 64
#: Pairs whose parities are compared at once, and words that are looked up at once in the other text of their pair.
PAIRS_AT_ONCE, WORDS_AT_ONCE = 20_000, 1_000_000
#: Of a text's rarest words so many go with the next one, to tell pairs that have met by an earlier word. A pair that meets
#: again after more words than these leaves again, so that rows grow with a text and not with its square.
EARLIER = 128
#: Rarest words of all texts that a group of words has about, the least number of groups, and words that are dealt out to
#: groups at once. A text goes to a group in one row, however many of its words are in it.
GROUPED, GROUPS, GROUPED_AT_ONCE = 30_000, 16, 50_000
#: Groups of 64 buckets of words whose counts' parities are kept of a text: the least, and how often they are doubled
#: for longer texts.
PARITIES, DOUBLED = 8, 5


def occurrence_labelled(shingles: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shingle hashes made different for the first, second ... time that a text has the same one."""
    own = mix(shingles ^ (doc.astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    s = own[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    nth = np.empty(len(s), U)
    nth[order] = (np.arange(len(s)) - first).astype(U)
    return mix(shingles + nth * U(0xD6E8FEB86659FD93))


def sketches(labelled: np.ndarray, first: np.ndarray, count: int, kept: int) -> np.ndarray:
    """texts x count keys. Each sketch takes the `kept` shingles with the least
    hashes under its own permutation and hashes them in the order of the text. first: where each text's shingles begin,
    and their end; no text may be empty."""
    begin, most = first[:-1], np.iinfo(np.uint64).max
    # The low bits of a permuted hash give way to its place, so that a minimum tells where it stands.
    low = U((1 << max(1, len(labelled).bit_length())) - 1)
    place = np.arange(len(labelled)).astype(U)
    draw = np.random.default_rng(23)
    flip, times = (draw.integers(0, 1 << 63, count, dtype=U) for _ in range(2))
    keys = np.zeros((len(begin), count), U)
    for j in range(count):
        h = labelled ^ flip[j]
        h *= times[j] | U(1)
        h &= ~low
        h |= place
        spots = []
        for _ in range(kept):
            least = np.minimum.reduceat(h, begin)
            # A text with fewer shingles than are kept repeats its first one; so does its copy.
            spot = (least & low).astype(np.int64)
            spots.append(np.where(least == most, spots[0], spot) if spots else spot)
            h[spots[-1]] = most
        for i, spot in enumerate(np.sort(np.stack(spots), axis=0)):
            keys[:, j] = mix(keys[:, j] * U(31) + labelled[spot] + U(i))
    return keys


def text_sketches(h: np.ndarray, first: np.ndarray, count: int = SKETCHES, kept: int = KEPT, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts with a word, their sketches) of the texts whose word hashes begin at `first`. A text
    shorter than a shingle is one shingle."""
    n = np.diff(first)
    rows = np.flatnonzero(n > 0)
    if not len(rows):
        return rows, np.zeros((0, count), U)
    grams = rolling(h, k)
    size = np.maximum(n[rows] - k + 1, 1)
    edge = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(edge[-1]) - np.repeat(edge[:-1], size) + np.repeat(first[:-1][rows], size)
    doc = np.repeat(np.arange(len(rows)), size)
    shingles = grams[np.minimum(at, max(len(grams) - 1, 0))] if len(grams) else np.zeros(len(at), U)
    for i in np.flatnonzero(n[rows] < k):
        own = np.array([7], U)
        for x in h[first[rows[i]] : first[rows[i] + 1]]:
            own = mix(own * U(31) + x)
        shingles[edge[i]] = own[0]
    return rows, sketches(occurrence_labelled(shingles, doc), edge, count, kept)


def edit_distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two word sequences if it is `limit` at most, else None, from alignments in a band around the
    diagonal that doubles until the distance fits it."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return None
    n = len(a)
    head = int(np.argmin(np.append(a == b[:n], False)))
    a, b = a[head:], b[head:]
    n = len(a)
    tail = int(np.argmin(np.append((a == b[len(b) - n :])[::-1], False)))
    a, b = a[: n - tail], b[: len(b) - tail]
    if not len(a):
        return len(b)
    # Words that the other side lacks each cost an edit.
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    if len(b) - common > limit:
        return None
    band = max(len(b) - common, 4)  # no distance is less
    while True:
        band = min(band, limit)
        found = _banded(a, b, band)
        if found is not None and found <= band:
            return found
        if band >= limit:
            return None
        band *= 2


#: Cells of a table of matching runs; longer texts or wider bands look runs up by hash instead.
TABLE_CELLS = 4_000_000


def _runs_by_table(a: np.ndarray, b: np.ndarray, band: int):
    """(places in a, diagonals) -> where the matching run from there ends, from a table over the whole band."""
    m = len(a)
    wide = np.concatenate((np.zeros(band, U), b, np.zeros(band + m, U)))
    seen = np.concatenate((np.zeros(band, bool), np.ones(len(b), bool), np.zeros(band + m, bool)))
    rows = np.lib.stride_tricks.sliding_window_view
    same = (rows(wide, m)[: 2 * band + 1] == a) & rows(seen, m)[: 2 * band + 1]
    end = np.full((2 * band + 1, m + 1), m, np.int32)
    end[:, :m] = np.where(same, m, np.arange(m, dtype=np.int32))
    end = np.minimum.accumulate(end[:, ::-1], axis=1)[:, ::-1]
    return lambda i, d: end[d + band, i]


def _runs_by_hash(a: np.ndarray, b: np.ndarray):
    """The same by halving, comparing running hashes of both sides; memory in proportion to the texts."""
    m, n = len(a), len(b)
    p = powers(max(m, n) + 1)
    ha, hb = (np.concatenate((np.zeros(1, U), np.cumsum(mix(x) * p[: len(x)], dtype=U))) for x in (a, b))

    def end(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        j = i + d
        up, down = p[np.maximum(d, 0)], p[np.maximum(-d, 0)]
        good, bad = np.zeros(len(i), np.int64), np.minimum(m - i, n - j) + 1
        while (bad - good > 1).any():
            mid = (good + bad) // 2
            same = (ha[i + mid] - ha[i]) * up == (hb[j + mid] - hb[j]) * down
            good, bad = np.where(same, mid, good), np.where(same, bad, mid)
        return i + good

    return end


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Edit distance along diagonals -band to band, exact if it is `band` at most: for each number of edits, how far along
    `a` each diagonal reaches; matching runs are skipped whole."""
    m, n = len(a), len(b)
    run = _runs_by_table(a, b, band) if (2 * band + 1) * m <= TABLE_CELLS else _runs_by_hash(a, b)
    goal, never = n - m, -(1 << 40)
    reach = np.full(2 * band + 3, never, np.int64)  # at d + band + 1, d being the place in b less that in a
    for edits in range(band + 1):
        lo, hi = max(-edits, -m, -band), min(edits, n, band)
        diag = np.arange(lo, hi + 1)
        at = diag + band + 1
        if edits:
            new = np.maximum(reach[at] + 1, np.maximum(reach[at - 1], reach[at + 1] + 1))
            new = np.minimum(new, np.minimum(m, n - diag))
            ok = (new >= 0) & (new + diag >= 0)
            diag, at, new = diag[ok], at[ok], new[ok]
        else:
            new = np.zeros(1, np.int64)
        reach[at] = run(new, diag)
        if abs(goal) <= band and reach[goal + band + 1] >= m:
            return edits
    return None


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - edit distance / length of the longer reaches `similarity`."""
    limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if len(a) == len(b) and np.count_nonzero(a != b) <= limit:
        return True  # the alignment along the diagonal alone is good enough
    return edit_distance_within(a, b, limit) is not None


def parities(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per text, whether each of 64 * p buckets of words has an odd number of them, packed into p numbers; p grows with
    the text. The halves of a longer one xored are the shorter one. Of words whose hashes are made different for each time
    that a text has them, as here, an edit changes two at most, and repeated ones don't cancel out."""
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        p = PARITIES << min(DOUBLED, max(0, ((hi - lo) // (64 * PARITIES)).bit_length()))
        out.append(_parity(hashes[lo:hi], p))
    return out


def _parity(hashes: np.ndarray, p: int) -> np.ndarray:
    n = np.bincount((hashes & U(64 * p - 1)).astype(np.int64), minlength=64 * p)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64)


def changed(odd: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many buckets the parities of texts a[k] and b[k] differ, in as many buckets as both have. A text's begin at
    first of odd."""
    out, wide = np.zeros(len(a), np.int64), np.diff(first)
    least = np.minimum(wide[a], wide[b])
    for p in np.unique(least).tolist():
        pairs, row, parts = np.flatnonzero(least == p), np.zeros(len(wide), np.int64), []
        for w in np.unique(wide[wide >= p]).tolist():
            own = np.flatnonzero(wide == w)
            row[own] = np.arange(len(own)) + sum(map(len, parts))
            parts.append(np.bitwise_xor.reduce(odd[first[own][:, None] + np.arange(w)].reshape(len(own), w // p, p), axis=1))
        folded = np.concatenate(parts)
        out[pairs] = np.bitwise_count(folded[row[a[pairs]]] ^ folded[row[b[pairs]]]).sum(1, dtype=np.int64)
    return out


def _listed(values: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _sketch_rows(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, first = words(data, offsets)
                h = word_hashes(data, starts, ends)
                rows, keys = text_sketches(h, first, count)
                odd = parities(occurrence_labelled(h, np.repeat(np.arange(part.num_rows), np.diff(first))), first)
                there = np.zeros(part.num_rows + 1, np.int64)
                there[rows + 1] = 1
                there = np.cumsum(there)
                parity = _listed(np.concatenate(odd), np.concatenate(([0], np.cumsum([len(x) for x in odd]))))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("sha"), _listed(keys.astype(np.int64).reshape(-1), there * count), pa.array(np.diff(first), pa.int64()), parity], ["id", "sha", "keys", "size", "parity"])

    return run


def _verified(similarity: float):
    """Rows come with each centre (first) before the texts that it is held against; the pairs that are similar leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: list[np.ndarray] = []
        closed = True
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, first = words(data, offsets)
                h = word_hashes(data, starts, ends)
                ok = []
                for i, head in enumerate(part.column("head").to_pylist()):
                    own = h[first[i] : first[i + 1]]
                    if head:
                        centres = [own.copy()] if closed else [*centres, own.copy()]
                    elif any(similar(c, own, similarity) for c in centres):
                        ok.append(i)
                    closed = not head
                keep = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("c").take(keep), part.column("m").take(keep)], ["c", "m"])

    return run


def components(links: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """(id, class): for every id in `links` (one, other) the smallest id that it hangs together with.

    Large-star and small-star steps by turns: each node's larger neighbours, then its smaller ones, are hung on the
    smallest neighbour, until all hang on the smallest of all. A node's neighbours are only counted down to a minimum, never gathered.
    """
    links = cut_lineage(links.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).where("a < b").distinct())
    while True:
        # All done if every id that hangs on another hangs on one alone, and nothing hangs on it.
        n, hanging = links.agg(F.count("*"), F.count_distinct("b")).first()
        if n == hanging and not links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written out, so that Spark can split a node with very many neighbours in the join.
        low = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = cut_lineage(large)
        release(links, low)
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        hung = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        links = cut_lineage(hung)
        release(large)
    return links.select(F.col("b").alias("id"), F.col("a").alias("class")).unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("class")).distinct())


def _words_of_texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, different for the first, second ... time that a text has a word; text of each; where each text begins)
    of a batch."""
    data, offsets = text_bytes(part.column("text"))
    starts, ends, first = words(data, offsets)
    doc = np.repeat(np.arange(part.num_rows), np.diff(first))
    return occurrence_labelled(word_hashes(data, starts, ends), doc), doc, first


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(64 - SLOT_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, doc, _ = _words_of_texts(part)
            slot, label = _slot(tokens), part.column("label").to_numpy()[doc]
            order = np.argsort(slot, kind="stable")
            own, first = np.unique(slot[order], return_index=True)
            n = np.diff(np.append(first, len(slot)))
            lo, hi = (f.reduceat(label[order], first) if len(first) else label for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (own, n, lo, hi)], ["slot", "n", "lo", "hi"])


def rarest(tokens: np.ndarray, doc: np.ndarray, first: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """Which tokens are the rarest of their text, one more than the edits that a similar text may be apart. Of two similar
    texts no more tokens than that lack a partner, on either side, and the order by common[slot] and hash is the same for all
    texts, so that they have one of these in common."""
    order = np.lexsort((tokens, common[_slot(tokens)], doc))
    most = np.floor((1 - similarity) * np.diff(first) + 1e-9).astype(np.int64) + 1
    return order[np.arange(len(tokens)) - first[:-1][doc] < most[doc]]


def _rare_rows(similarity: float, dealt: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, mixed = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, doc, first = _words_of_texts(part)
                at = rarest(tokens, doc, first, common, similarity)
                slot = _slot(tokens[at])
                at, slot = at[mixed[slot]], slot[mixed[slot]]
                odd = [_parity(tokens[lo:hi], min(WIDEST, max(PARITIES, 1 << ((hi - lo) // 16).bit_length()))) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
                ends = np.append(0, np.cumsum(np.bincount(doc[at], minlength=part.num_rows)))
                # Their upper halves, with the slot: two words that have the same one meet as if they were one, in the same order.
                lists = [_listed(np.concatenate(odd), np.append(0, np.cumsum([len(x) for x in odd]))), _listed((tokens[at] >> U(32)).astype(np.uint32).view(np.int32), ends, pa.int32()), _listed(-(-common[slot] // dealt), ends)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first), pa.int64()), *lists], ["text_id", "size", "odd", "w", "blocks"])

    return run


def _rare_words(bodies: DataFrame, similarity: float) -> DataFrame:
    """(text_id, size, odd: parities, w: the rarest words, the rarest first, blocks: how many each word's texts are dealt out in) of bodies (id,
    text, label: a number of the class). Words are counted in slots; those of slots whose texts are all of one class are left out of w."""
    kind = bodies.schema["id"].dataType.simpleString()
    seen = bodies.select("text", "label").mapInArrow(_counted, "slot long, n long, lo long, hi long").groupBy("slot").agg(F.sum("n").alias("n"), (F.min("lo") < F.max("hi")).alias("mixed")).toArrow()
    common, mixed = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, bool)
    common[seen["slot"].to_numpy()], mixed[seen["slot"].to_numpy()] = seen["n"].to_numpy(), seen["mixed"].to_numpy()
    sent = bodies.sparkSession.sparkContext.broadcast((common, mixed))
    return cut_lineage(bodies.select("id", "text").mapInArrow(_rare_rows(similarity, DEALT, sent), f"text_id {kind}, size long, odd array<long>, w array<int>, blocks array<long>"))


def met_earlier(words: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a[k] and b[k] have one of their words in common. A row's begin at first of words."""
    own, ids = np.unique(words, return_inverse=True)
    n = np.diff(first)
    here = np.sort(np.repeat(np.arange(len(n)), n) * len(own) + ids)
    a, b = np.where(n[a] > n[b], b, a), np.where(n[a] > n[b], a, b)
    out, many = np.zeros(len(a), bool), np.cumsum(n[a])
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(many // WORDS_AT_ONCE)) + 1):
        k = np.repeat(part, n[a[part]])
        if len(k):
            nth = np.arange(len(k)) - np.repeat(np.cumsum(n[a[part]]) - n[a[part]], n[a[part]])
            looked = b[k] * len(own) + ids[first[a[k]] + nth]
            found = here[np.minimum(np.searchsorted(here, looked), len(here) - 1)] == looked
            out[k[found]] = True
    return out


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[k], start[k] + 1 ... of each run of n[k] places."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, where each list's begin, and their end)."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))


def _group_rows(groups: int, most: int, at_once: int):
    """Texts come (text_id, h, label, size, odd, w, blocks); a row of each text and group that some of its words are in
    leaves. With it go these words, the blocks i and j that each is held against in and its own, and, once for all of them,
    the words of the text before each, `most` at most: of `earlier`, a word's are the last `back` ones up to `end`."""
    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        (w, first), (blocks, _) = _flat(part.column("w")), _flat(part.column("blocks"))
        doc, nth = np.repeat(np.arange(part.num_rows), np.diff(first)), _runs(np.zeros(part.num_rows, np.int64), np.diff(first))
        own = (mix(part.column("h").to_numpy().view(U)[doc] ^ mix(w.astype(U))) % blocks.astype(U)).astype(np.int64)
        k, other = np.repeat(np.arange(len(w)), blocks), _runs(np.zeros(len(w), np.int64), blocks)
        i, j = np.minimum(own[k], other), np.maximum(own[k], other)
        g = (mix(mix(w[k].astype(U)) + (i << 32 | j).astype(U)) % U(groups)).astype(np.int64)
        order = np.lexsort((nth[k], g, doc[k]))
        k, i, j, g = k[order], i[order], j[order], g[order]
        d, s = doc[k], nth[k]
        begin = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (g[1:] != g[:-1]))[: len(k)])
        before = np.append(0, s[:-1])[: len(k)]
        before[begin] = 0
        n = np.minimum(s - before, most)
        end, last = np.cumsum(n), np.append(begin[1:], len(k)) - 1
        ends = np.append(0, end[last]) if len(begin) else np.zeros(1, np.int64)
        words_at = np.append(begin, len(k))
        there = pa.array(d[begin])
        lists = [_listed(x, words_at, pa.int32()) for x in (w[k], end - np.repeat(ends[:-1], np.diff(words_at)), np.minimum(s, most), i, j, own[k])]
        return pa.RecordBatch.from_arrays([pa.array(g[begin], pa.int64()), *(part.column(x).take(there) for x in ("text_id", "h", "label", "size", "odd")), _listed(w[_runs(first[d] + s - n, n)], ends, pa.int32()), *lists], ["g", "text_id", "h", "label", "size", "odd", "earlier", "w", "end", "back", "i", "j", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, first = _flat(batch.column("blocks"))
            many = np.append(0, np.cumsum(blocks))[first[1:]]
            cuts = [0, *(np.flatnonzero(np.diff(many // at_once)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo:
                    yield rows(batch.slice(lo, hi - lo))

    return run


def _met(similarity: float):
    """Rows come group by group (g), as _group_rows makes them; the pairs leave, with the numbers of their classes, that have a word
    in common, whose classes differ, whose sizes and parities allow a link and that have none of the words before that one in
    common, so that of all words of a pair the first one lets it leave. i, j: the blocks of a word's texts
    that are held against each other; earlier: the last EARLIER words before a word in their text's order."""
    def pairs(rows: pa.Table) -> pa.RecordBatch:
        (w, at_row), (end, _), (back, _), (i, _), (j, _), (block, _), (earlier, early), (odd, first) = (_flat(rows[x].combine_chunks()) for x in ("w", "end", "back", "i", "j", "block", "earlier", "odd"))
        odd, row = odd.view(U), np.repeat(np.arange(rows.num_rows), np.diff(at_row))
        start = early[row] + end - back
        order = np.lexsort((j, i, w))
        w, i, j, block, start, back, row = (x[order] for x in (w, i, j, block, start, back, row))
        h, label, size = (rows[x].to_numpy()[row] for x in ("h", "label", "size"))
        begin = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        stop = np.repeat(np.append(begin[1:], len(w)), np.diff(np.append(begin, len(w))))

        def near(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            c, m, most = (np.concatenate(x) for x in zip(*found))
            ok = np.concatenate([np.zeros(0, bool), *(changed(odd, first, row[c[lo : lo + PAIRS_AT_ONCE]], row[m[lo : lo + PAIRS_AT_ONCE]]) <= most[lo : lo + PAIRS_AT_ONCE] for lo in range(0, len(c), PAIRS_AT_ONCE))])
            c, m = c[ok], m[ok]
            used, nth = np.unique(np.concatenate((c, m)), return_inverse=True)
            ok = ~met_earlier(earlier[_runs(start[used], back[used])], np.append(0, np.cumsum(back[used])), nth[: len(c)], nth[len(c) :]) if len(c) else np.zeros(0, bool)
            return c[ok], m[ok]

        at, apart, found, late = np.arange(len(w)), 0, [(np.zeros(0, np.int64),) * 3], []
        while len(at):
            apart += 1
            at = at[at + apart < stop[at]]
            c, m = at, at + apart
            ok = (label[c] != label[m]) & ((i[c] == j[c]) | (block[c] != block[m]))
            c, m = c[ok], m[ok]
            edits = np.floor((1 - similarity) * np.maximum(size[c], size[m]) + 1e-9)
            longer = np.abs(size[c] - size[m])
            ok = longer <= edits
            found.append((c[ok], m[ok], (2 * edits - longer)[ok]))
            if not len(at) or sum(len(x) for x, _, _ in found) >= PAIRS_AT_ONCE:
                late.append(near(found))
                found = found[:1]
        c, m = (np.concatenate(x) for x in zip(*late))
        c, m = np.where(h[c] > h[m], m, c), np.where(h[c] > h[m], c, m)
        one = np.unique(np.stack((h[c], h[m]), axis=1), axis=0, return_index=True)[1]
        c, m, ids = c[one], m[one], rows["text_id"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row[c])), ids.take(pa.array(row[m])), pa.array(np.minimum(label[c], label[m])), pa.array(np.maximum(label[c], label[m]))], ["c", "m", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            g = rows["g"].to_numpy()
            # The last group may go on in the next batch; those before it are looked at one by one.
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield pairs(rows.slice(lo, hi - lo))
            rest = rows.slice(cuts[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return run


def _by_words(rare: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(c, m, lo, hi: numbers of their classes): the pairs of texts in `rare` that share one of their rarest words, are of different classes and may be linked.
    The texts of a frequent word are dealt out in blocks, and every two blocks are held against each other."""
    return _word_rows(rare, classes).mapInArrow(_met(similarity), _met_kind(rare)).distinct()


def _met_kind(rare: DataFrame) -> str:
    kind = rare.schema["text_id"].dataType.simpleString()
    return f"c {kind}, m {kind}, lo long, hi long"


def _word_rows(rare: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows that _met takes, those of a group of words together. Groups are as many as keep each at about GROUPED words
    of texts, so that one fits a worker and rows are never more than the rarest words of all texts."""
    labelled = rare.join(classes.withColumnRenamed("id", "text_id"), "text_id", "left")
    texts = labelled.select("text_id", F.xxhash64("text_id").alias("h"), F.xxhash64(F.coalesce("class", "text_id")).alias("label"), "size", "odd", "w", "blocks")
    n = rare.agg(F.sum(F.aggregate("blocks", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    kind = f"g long, text_id {rare.schema['text_id'].dataType.simpleString()}, h long, label long, size long, odd array<long>, earlier array<int>, w array<int>, end array<int>, back array<int>, i array<int>, j array<int>, block array<int>"
    # Dealt anew, as texts of many words may stand together.
    grouped = texts.repartition("text_id").mapInArrow(_group_rows(max(GROUPS, -(-n // GROUPED)), EARLIER, GROUPED_AT_ONCE), kind)
    return grouped.repartition("g").sortWithinPartitions("g")


def _edits(similarity: float, x: str, y: str) -> Column:
    """Edits that a pair of these sizes may be apart."""
    return F.floor(F.lit(1 - similarity) * F.greatest(x, y) + 1e-9)


def _may_align(similarity: float) -> Column:
    """Whether lengths and parities allow it: an edit changes the length by one or not at all, and one parity or two at most."""
    edits = _edits(similarity, "c_size", "m_size")
    n = F.least(F.size("c_parity"), F.size("m_parity"))
    folded = lambda x: F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    changed = F.aggregate(F.zip_with(folded("c_parity"), folded("m_parity"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    longer = F.abs(F.col("c_size") - F.col("m_size"))
    return (longer <= edits) & (changed <= 2 * edits - longer)


def _few(ids: DataFrame, broadcast_ids: int) -> bool:
    return ids.limit(broadcast_ids + 1).count() <= broadcast_ids


def _links(pairs: DataFrame, texts: DataFrame, bodies: DataFrame, similarity: float, broadcast_ids: int) -> DataFrame:
    """The pairs (c, m) of ids whose texts, in bodies (id, text), are similar. A centre's text is sent once for FAN others."""
    side = lambda x: texts.select(F.col("text_id").alias(x), *(F.col(v).alias(f"{x}_{v}") for v in ("size", "parity")))
    pairs = pairs.join(side("c"), "c").join(side("m"), "m").where(_may_align(similarity))
    pairs = cut_lineage(pairs.select("c", "m").distinct())
    many = pairs.groupBy("c").agg(F.ceil(F.count("*") / FAN).alias("copies")).where("copies > 1")
    dealt = pairs.join(many, "c", "left").select("c", "m", F.pmod(F.xxhash64("m"), F.coalesce("copies", F.lit(1).cast("long"))).alias("copy"))
    wanted = cut_lineage(dealt.select("c", "copy", F.col("m").alias("id"), F.lit(False).alias("head")).unionByName(dealt.select("c", "copy", F.col("c").alias("id"), F.lit(True).alias("head")).distinct()))
    ids = wanted.select("id").distinct()
    if _few(ids, broadcast_ids):
        bodies = bodies.join(F.broadcast(ids), "id", "left_semi")
    rows = wanted.join(bodies, "id").repartition("c", "copy").sortWithinPartitions("c", "copy", F.desc("head"))
    kind = pairs.schema["c"].dataType.simpleString()
    found = cut_lineage(rows.select("c", F.col("id").alias("m"), "head", "text").mapInArrow(_verified(similarity), f"c {kind}, m {kind}").distinct())
    release(pairs, wanted)
    return found


def _open(members: DataFrame, classes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The members (key, text_id, class, size, n, centres) of sketches whose texts are of several classes. CENTRES texts
    of each such sketch are its centres, drawn by a hash of text and sketch, so that every sketch has others. texts: where
    sizes are to be looked up, if the members don't have them."""
    own = members.select("key", "text_id", *(() if texts is not None else ("size", "looked_up")))
    labelled = own.join(classes.withColumnRenamed("id", "text_id"), "text_id", "left").withColumn("class", F.coalesce("class", "text_id"))
    drawn = F.array_distinct(F.array(*(F.min_by("text_id", F.xxhash64("text_id", "key", F.lit(i))) for i in range(CENTRES))))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"), drawn.alias("centres")).where("lo < hi")
    labelled = labelled.join(mixed.select("key", "n", "centres"), "key")
    return cut_lineage(labelled.join(texts.select("text_id", "size"), "text_id") if texts is not None else labelled)


def _may_link(similarity: float) -> Column:
    """Whether classes and sizes of c and m allow a link that tells something new."""
    return (F.col("c_class") != F.col("class")) & (F.abs(F.col("c_size") - F.col("size")) <= _edits(similarity, "c_size", "size"))


def _candidates(members: DataFrame, every: bool, similarity: float) -> DataFrame:
    """(c, m): pairs that share a sketch of SMALL texts at most; all of them, or those with a centre, but none of which both
    texts are looked up by words."""
    own = members if every else members.where(F.array_contains("centres", F.col("text_id")))
    own = own.select("key", F.col("text_id").alias("c"), F.col("class").alias("c_class"), F.col("size").alias("c_size"), F.col("looked_up").alias("c_looked_up"))
    met = members.join(own, "key").where(~(F.col("c_looked_up") & F.col("looked_up")) & _may_link(similarity))
    # Of a pair the first by hash is the one that is sent to the other.
    turned = F.xxhash64("c") > F.xxhash64("text_id")
    return met.select(F.when(turned, F.col("text_id")).otherwise(F.col("c")).alias("c"), F.when(turned, F.col("c")).otherwise(F.col("text_id")).alias("m")).distinct()


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (c, m) whose classes differ."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("class").alias(f"{x}_class"))
    both = pairs.join(side("c"), "c", "left").join(side("m"), "m", "left")
    return both.where(F.coalesce("c_class", "c") != F.coalesce("m_class", "m")).select("c", "m")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, doc_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, count: int = SKETCHES) -> DataFrame:
    """(doc_col, class_id, text_id), a row for every id: its class, the smallest id among the documents it hangs together
    with, and text_id, the smallest id with the same text.

    Equal texts are one text from here on. Each of `count` order-MinHash sketches hashes KEPT of a text's
    occurrence-labelled five-word shingles, those least under its permutation, in the order of the text. Texts that share
    a sketch are candidates; a pair is a link if its words align, within a band, at `similarity` or more:
    1 - edit distance / words of the longer. Linked texts, and those that they link to, are a class.

    First the texts of a sketch are compared to its centre, the first by hash, which is the same for most sketches of a
    group of copies: n comparisons for n copies. Where the texts of a sketch are of several classes then, they are compared
    to CENTRES others, drawn anew for each sketch, and in the end all pairs of different classes are. In a sketch of more
    than SMALL texts, of a passage that many texts share, pairs are not listed: similar texts have one of their rarest words
    in common (`rarest`), whatever passage they share, so those that share one are compared, first one pair of each two classes,
    then all whose classes still differ. Before a pair is aligned its lengths and the parities of
    its word counts must allow a link, which those of no similar pair forbid.

    Null texts and those without a word are alone in their class, but for equal ones. Rows that repeat an id are one
    document, whatever their texts. Rows with a null id are left out. An empty table gives an empty result; columns not
    named are ignored. Very long texts are sketched and aligned whole.
    """
    own = docs.select(F.col(doc_col).alias("id"), F.col(text_col).alias("text"), F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(text_col)), F.lit("")), 256)).alias("sha")).where(F.col("id").isNotNull())
    kind = own.schema["id"].dataType.simpleString()
    seen = own.mapInArrow(_sketch_rows(count), f"id {kind}, sha binary, keys array<long>, size long, parity array<long>")
    texts = seen.groupBy("sha").agg(F.min(F.struct("id", "keys", "size", "parity")).alias("x"))
    texts = cut_lineage(texts.select("sha", F.col("x.id").alias("text_id"), "x.keys", "x.size", "x.parity"))
    bodies = own.select("id", "text")

    keyed = texts.select("text_id", F.explode(F.array_distinct("keys")).alias("key")).repartition("key")
    centres = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("text_id", F.xxhash64("text_id")).alias("c")).where("n > 1").select("key", "c")
    members = cut_lineage(keyed.join(centres, "key"))
    tried = cut_lineage(members.where(F.col("text_id") != F.col("c")).select("c", F.col("text_id").alias("m")).distinct())
    sweep(docs.sparkSession)
    links = _links(tried, texts, bodies, similarity, broadcast_ids)
    classes = components(links, "c", "m")
    release(links)
    sweep(docs.sparkSession)
    opened = _open(members, classes, texts)
    release(members)
    large = cut_lineage(opened.where(F.col("n") > SMALL).select(F.col("text_id").alias("id"), F.xxhash64("class").alias("label")).distinct())
    few = _few(large, broadcast_ids)
    rare = None if _few(large, 0) else _rare_words(bodies.join(F.broadcast(large) if few else large, "id"), similarity)
    members = opened.where(F.col("n") <= SMALL).join(large.select(F.col("id").alias("text_id"), F.lit(True).alias("looked_up")), "text_id", "left").withColumn("looked_up", F.coalesce("looked_up", F.lit(False)))
    members, opened = opened, cut_lineage(members)
    release(members, large)
    met = None if rare is None else cut_lineage(_by_words(rare, classes, similarity))
    sweep(docs.sparkSession)
    for every in (False, True):
        pairs = _candidates(opened, every, similarity)
        if met is not None:
            more = _apart(met, classes) if every else met.groupBy("lo", "hi").agg(F.min(F.struct("c", "m")).alias("x")).select("x.c", "x.m")
            pairs = pairs.unionByName(more).distinct()
        pairs = cut_lineage(pairs.join(tried, ["c", "m"], "left_anti"))
        if pairs.limit(1).count():
            more = _links(pairs, texts, bodies, similarity, broadcast_ids)
            if more.limit(1).count():
                classes = components(classes.select(F.col("class").alias("c"), F.col("id").alias("m")).unionByName(more), "c", "m")
            release(more)
            sweep(docs.sparkSession)
            tried = tried.unionByName(pairs)
        if not every:
            members, opened = opened, _open(opened, classes)
            release(members)

    found = texts.select("sha", "text_id").join(classes.withColumnRenamed("id", "text_id"), "text_id", "left")
    out = own.select("id", "sha").join(found, "sha").groupBy("id").agg(F.min(F.coalesce("class", "text_id")).alias("class_id"), F.min("text_id").alias("text_id"))
    return out.withColumnRenamed("id", doc_col)
