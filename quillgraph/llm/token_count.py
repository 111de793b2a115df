"""Token counts: greedy longest-match lengths from a trie with failure links, without building the pieces."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.kernels import slices, text_bytes, words, word_hashes


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a rank file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Greedy longest-match from the left over a vocabulary, one state per byte.

    A node stands for bytes read and not yet given out. Where it has no edge for the next byte, its failure link leads
    to the node of what remains once the longest tokens at its front are popped, and `pops` says how many these are.
    A node that can't be resolved (a part of it is no token) has link -1: the word is unknown and counts 1.
    """

    def __init__(self, vocabulary: list[bytes]):
        edges: list[dict[int, int]] = [{}]
        token = [False]
        parent, byte = [0], [0]
        for t in vocabulary:
            at = 0
            for b in t:
                if b not in edges[at]:
                    edges[at][b] = len(edges)
                    edges.append({})
                    token.append(False)
                    parent.append(at)
                    byte.append(b)
                at = edges[at][b]
            token[at] = bool(t) or token[at]
        n = len(edges)
        link, pops = [-1] * n, [0] * n
        queue = deque(edges[0].values())
        while queue:
            v = queue.popleft()
            queue.extend(edges[v].values())
            if token[v]:
                link[v], pops[v] = 0, 1
                continue
            # What stays of the parent takes the byte; each failure on the way pops more tokens.
            z, popped = link[parent[v]], pops[parent[v]]
            while z >= 0 and byte[v] not in edges[z]:
                popped += pops[z]
                z = link[z]
            if z >= 0:
                link[v], pops[v] = edges[z][byte[v]], popped
        # Tokens given out if the word ends here.
        flush = [0] + [-1] * (n - 1)
        for v in range(1, n):
            seen = 0
            z = v
            while z > 0:
                seen += pops[z]
                z = link[z]
            flush[v] = seen if z == 0 else -1
        self.link, self.pops, self.flush = (np.array(x, np.int32) for x in (link, pops, flush))
        # Edges in an open hash table of (node, byte).
        keys = np.array([v * 256 + b for v in range(n) for b in edges[v]], np.int64)
        to = np.array([w for v in range(n) for w in edges[v].values()], np.int32)
        bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[free[one]]
            self.keys[at[one]], self.to[at[one]] = keys[one], to[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, to, at = keys[rest], to[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node behind each edge, -1 where there is none."""
        key = node.astype(np.int64) * 256 + byte
        at = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            k = self.keys[at[open_]]
            hit = k == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (k >= 0)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: bytes) -> np.ndarray:
        """Pieces of each word with `prefix` before it; all words move on by a byte at a time, longest first."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        node, count, dead = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        for j in range(-len(prefix), int(size[0]) if len(size) else 0):
            n = len(order) if j < 0 else int(np.searchsorted(-size, -j))
            byte = np.full(n, prefix[j], np.uint8) if j < 0 else data[starts[:n] + j]
            left = np.flatnonzero(~dead[:n])
            while len(left):
                to = self.step(node[left], byte[left])
                ok = to >= 0
                node[left[ok]] = to[ok]
                left = left[~ok]
                count[left] += self.pops[node[left]]
                node[left] = self.link[node[left]]
                lost = node[left] < 0
                dead[left[lost]] = True
                left = left[~lost]
        end = self.flush[np.maximum(node, 0)]
        count = np.where(dead | (end < 0), 1, count + end)
        out = np.empty(len(order), np.int64)
        out[order] = count
        return out



def token_counts(docs: DataFrame, vocabulary: list[bytes], prefix: bytes = b" ", doc_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_col, the columns in keep, n_words and n_tokens per row of docs.

    Words are runs of characters that aren't ASCII white space. Each, with `prefix` before it, is cut into the longest
    tokens of the vocabulary from left to right, and n_tokens is the number of these pieces over the whole text; a word
    with a byte that no token covers counts 1. The vocabulary's size is a parameter's, and its automaton is broadcast;
    equal words of a batch are counted once.

    Null and empty texts have none of either; repeated rows get equal counts; very long texts and words are walked
    byte by byte in constant memory beside the text; an empty table gives an empty result.
    """
    if prefix and not vocabulary:
        raise ValueError("the vocabulary is empty")
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        for batch in batches:
            for part in slices(batch, "_text"):
                data, offsets = text_bytes(part.column("_text"))
                starts, ends, first = words(data, offsets)
                _, one, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                total = np.concatenate(([0], np.cumsum(a.counts(data, starts[one], ends[one], prefix)[back])))
                yield pa.RecordBatch.from_arrays([part.column("_keep"), pa.array(np.diff(first).astype(np.int64)), pa.array(np.diff(total[first]).astype(np.int64))], ["_keep", "n_words", "n_tokens"])

    own = docs.select(F.struct(F.col(doc_col), *(F.col(c) for c in keep if c != doc_col)).alias("_keep"), F.col(text_col).alias("_text"))
    schema = own.select("_keep").withColumns({"n_words": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema
    return own.mapInArrow(run, schema).select("_keep.*", "n_words", "n_tokens")
