"""Compressed FM-index over word sequences, with a wavelet matrix, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: bits packed into words of 64, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n + 64) // 64 * 64, bool)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64)))).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))


class WaveletMatrix:
    """rank(symbol, i) over an integer sequence, by one bit vector per bit of the alphabet, highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        for b in range(self.depth - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo, and before hi."""
        start = np.zeros(len(symbol), np.int64)
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        for level, zeros, b in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            s1, l1, h1 = level.rank1(start), level.rank1(lo), level.rank1(hi)
            start = np.where(one, zeros + s1, start - s1)
            lo = np.where(one, zeros + l1, lo - l1)
            hi = np.where(one, zeros + h1, hi - h1)
        return lo - start, hi - start


class FMIndex:
    """Index of texts (arrays of 64-bit word hashes), each with the number of the document that it is from.

    Rows stand in the order of the first `window` words after them, so a pattern of up to `window` words is a range of
    rows; what lies beyond isn't ordered, which saves the last rounds of sorting. Between texts stands a separator that
    no pattern holds.
    """

    def __init__(self, tokens: np.ndarray, first: np.ndarray, doc: np.ndarray, window: int):
        """tokens of all texts, one after the other; first: where each begins, and the end; doc: of each text."""
        self.window = window
        count = len(first) - 1
        self.alphabet, ids = np.unique(tokens, return_inverse=True)
        size = np.diff(first)
        n = len(tokens) + count
        text = np.zeros(n, np.int64)
        owner = np.repeat(np.arange(count), size)
        self.first = first[:-1] + np.arange(count)
        text[np.arange(len(tokens)) + owner] = ids + 1
        self.text, self.size = text, size
        self.sigma = len(self.alphabet) + 1
        # Rank of every position by its first 1, 2, 4 ... words; window - 1 and window come from overlapping halves.
        rank, have = text, 1

        def joined(rank: np.ndarray, shift: int) -> np.ndarray:
            after = np.zeros(n, np.int64)
            after[: max(0, n - shift)] = rank[shift:] + 1
            return np.unique(rank * (n + 2) + after, return_inverse=True)[1] if n else rank

        shorter = text
        while have < window:
            if have <= window - 1 <= 2 * have:
                shorter = joined(rank, window - 1 - have) if window - 1 > have else rank
            step = min(have, window - have)
            rank = joined(rank, step)
            have += step
        order = np.argsort(rank, kind="stable")
        before = np.roll(text, 1)[order]
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.wavelet = WaveletMatrix(before, self.sigma)
        # Ranges of rows that agree in window - 1 words, and the least document of those that agree in `window`.
        edge = np.flatnonzero(np.diff(shorter[order], prepend=-1))
        group = np.searchsorted(edge, np.arange(n), "right") - 1
        self.lo, self.hi = edge[group], np.append(edge[1:], n)[group]
        edge = np.flatnonzero(np.diff(rank[order], prepend=-1))
        spread = np.concatenate((np.repeat(doc, size + 1),)) if count else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(spread[order], edge)[np.searchsorted(edge, np.arange(n), "right") - 1] if n else spread

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranges of rows that begin with symbol and go on as those in [lo, hi)."""
        a, b = self.wavelet.ranks(symbol, lo, hi)
        base = self.counts[symbol]
        return base + a, base + b

    def symbols(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers of words in the index, 0 for those that aren't there."""
        at = np.minimum(np.searchsorted(self.alphabet, tokens), max(len(self.alphabet) - 1, 0))
        return np.where(self.alphabet[at] == tokens, at + 1, 0) if len(self.alphabet) else np.zeros(len(tokens), np.int64)

    def statistics(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed texts, cut at `window`, and the least document that holds the whole window.

        For each position, how many words from there on (up to `window`) stand somewhere in the index; and where that
        is `window`, the least document in which they do, else -1. Each text is read from its end by backward search.
        Before a step the range is widened to the rows that agree in window - 1 words, so that it stands for exactly
        the next window; where a word doesn't fit, the search begins anew with shorter and shorter matches.
        """
        symbol = self.symbols(tokens)
        length = np.zeros(len(tokens), np.int64)
        least = np.full(len(tokens), -1, np.int64)
        lane = np.flatnonzero(np.diff(first) > 0)
        at = first[1:][lane] - 1  # the position that each lane asks about
        depth, lo, hi = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.full(len(lane), len(self.text), np.int64)
        begin, end = first[:-1][lane], first[1:][lane]
        n = len(self.text)
        while len(at):
            a, b = self.extend(symbol[at], lo, hi)
            fits = (a < b) & (symbol[at] > 0)
            miss = np.flatnonzero(~fits)
            # The longest prefix of what follows that does fit, by plain backward search of each length, halved.
            if len(miss):
                good = np.zeros(len(miss), np.int64)
                bad = depth[miss] + 1
                ga, gb = np.zeros(len(miss), np.int64), np.zeros(len(miss), np.int64)
                while len(todo := np.flatnonzero(bad - good > 1)):
                    mid = (good[todo] + bad[todo]) // 2
                    x, y = self._range(symbol, at[miss[todo]], mid)
                    ok = x < y
                    good[todo[ok]], ga[todo[ok]], gb[todo[ok]] = mid[ok], x[ok], y[ok]
                    bad[todo[~ok]] = mid[~ok]
                depth[miss] = good - 1
                a[miss], b[miss] = np.where(good > 0, ga, 0), np.where(good > 0, gb, n)
            depth = depth + 1
            length[at] = depth
            full = depth >= self.window
            least[at[full]] = self.least[a[full]]
            lo, hi = np.where(full, self.lo[np.minimum(a, n - 1)], a), np.where(full, self.hi[np.minimum(a, n - 1)], b)
            depth = np.where(full, self.window - 1, depth)
            at = at - 1
            go = at >= begin
            at, depth, lo, hi, begin, end = at[go], depth[go], lo[go], hi[go], begin[go], end[go]
        return length, least

    def _range(self, symbol: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with the `size` words from `at` on."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.text), np.int64)
        for k in range(int(size.max(initial=0)) - 1, -1, -1):
            on = np.flatnonzero((k < size) & (lo < hi))
            s = symbol[at[on] + k]
            a, b = self.extend(s, lo[on], hi[on])
            lo[on], hi[on] = a, np.where(s > 0, b, a)
        return lo, hi
