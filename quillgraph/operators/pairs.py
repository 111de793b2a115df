"""Pairs of similar vectors of one type, block by block, by matrix products.

A type is dealt to blocks, and each two blocks meet in one group, so that a group holds two blocks whatever the type's size.
The product of unit vectors only says which pairs may matter; those are scored again as functions.vector.cosine does it,
component by component in order, so that scores, ties and what reaches a threshold are the expression's to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block (about), rows of it that are multiplied at once, pairs that are scored at once, and groups of columns.
BLOCK, SHEET, PART, GROUPS = 8192, 512, 1 << 16, 128
#: What a product of unit vectors may be off, and far more.
SURE = 1e-9


@dataclass
class _Block:
    """Rows by id: vectors with components first, norms, and unit vectors, NaN where they may be imprecise."""

    ids: pa.Array
    by_part: np.ndarray
    norm: np.ndarray
    unit: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> _Block:
        rows = rows.take(pc.sort_indices(rows.column("id")))
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        v = flat.reshape(rows.num_rows, -1)
        by_part = np.ascontiguousarray(v.T)
        square = np.zeros(len(v))
        for x in by_part:
            square += x * x
        norm = np.sqrt(square)
        unit = v / norm[:, None]
        unit[~(np.isfinite(square) & (square > 1e-290))] = np.nan
        unit[norm == 0] = 0
        ids = rows.column("id").combine_chunks()
        return _Block(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, by_part, norm, unit)

    def __len__(self) -> int:
        return len(self.norm)

    def firsts(self, n: int) -> np.ndarray:
        """Places of the rows that are among the first n of those with an equal vector."""
        rows = np.ascontiguousarray(self.by_part.T)
        _, kind = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1])))[:, 0], return_inverse=True)
        order = np.argsort(kind, kind="stable")
        nth = np.empty(len(kind), np.int64)
        nth[order] = np.arange(len(kind)) - np.searchsorted(kind[order], kind[order])
        return np.flatnonzero(nth < n)


@dataclass(frozen=True)
class Measure:
    """Threshold on the cosine, or on the index scale."""

    threshold: float
    normalized: bool = True

    @property
    def least(self) -> float:
        return 2 * self.threshold - 1 if self.normalized else self.threshold

    def reached(self, a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, score) of the pairs that reach the threshold; NaN does, as it is above all numbers in Spark."""
        score = np.empty(len(i))
        there = np.empty(len(i), bool)
        for lo in range(0, len(i), PART):
            x, y = i[lo : lo + PART], j[lo : lo + PART]
            dot = np.zeros(len(x))
            for p, q in zip(a.by_part, b.by_part):
                dot += p[x] * q[y]
            norm = a.norm[x] * b.norm[y]
            there[lo : lo + PART] = ~(norm <= 0)
            score[lo : lo + PART] = dot / norm
        if self.normalized:
            score = (1 + score) / 2
        keep = there & ~(score < self.threshold)
        return i[keep], j[keep], score[keep]


def _listed(a: _Block, b: _Block, own: bool, measure: Measure) -> Iterator[tuple[_Block, _Block, np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a group."""
    for lo in range(0, len(a), SHEET):
        first = lo if own else 0
        hit = ~(a.unit[lo : lo + SHEET] @ b.unit[first:].T < measure.least - SURE)
        i, j = np.nonzero(np.triu(hit, 1) if own else hit)
        for at in range(0, len(i), 16 * PART):
            yield a, b, *measure.reached(a, b, i[at : at + 16 * PART] + lo, j[at : at + 16 * PART] + first)


def _linked(a: _Block, b: _Block, own: bool, measure: Measure) -> Iterator[tuple[_Block, _Block, np.ndarray, np.ndarray, np.ndarray]]:
    """Each row of a group with the first one that it hangs together with."""
    shift = 0 if own else len(a)
    root = np.arange(shift + len(b))
    for lo in range(0, len(a), SHEET):
        first = lo if own else 0
        product = a.unit[lo : lo + SHEET] @ b.unit[first:].T
        hit = ~(product < measure.least - SURE)
        i, j = np.nonzero(np.triu(hit, 1) if own else hit)
        near = product[i, j]
        i, j = i + lo, j + first
        apart = root[i] != root[j + shift]
        i, j, near = i[apart], j[apart], near[apart]
        sure = near > measure.least + SURE
        x, y, _ = measure.reached(a, b, i[~sure], j[~sure])
        x, y = np.concatenate([i[sure], x]), np.concatenate([j[sure], y]) + shift
        while len(x):
            p, q = root[x], root[y]
            x, y, p, q = (z[p != q] for z in (x, y, p, q))
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root != (up := root[root])).any():
                root = up
    i = np.flatnonzero(root != np.arange(len(root)))
    both = _Block(pa.concat_arrays([a.ids] if own else [a.ids, b.ids]), np.empty((0, 0)), np.empty(0), np.empty(0))
    yield both, both, i, root[i], np.ones(len(i))


def _nearest(k: int) -> Callable:
    def best(a: _Block, b: _Block, own: bool, measure: Measure) -> Iterator[tuple[_Block, _Block, np.ndarray, np.ndarray, np.ndarray]]:
        """The k best of each row of a among b, equal scores by id. Of equal vectors none needs more than the first k and
        one, as one may be the row itself."""
        again = len(b) - len(pc.unique(b.ids))
        places = np.arange(len(b)) if again else b.firsts(k + 1)
        unit, none = b.unit[places].T, b.norm[places] == 0
        strange = bool(np.isnan(a.unit).any() or np.isnan(unit).any())
        for lo in range(0, len(a), SHEET):
            near = a.unit[lo : lo + SHEET] @ unit
            odd = np.isnan(near) if strange else None
            if strange:
                near[odd] = -np.inf
            if none.any():
                near[:, none] = -np.inf
            if own and again:
                number = pc.index_in(b.ids, pc.unique(b.ids)).to_numpy()
                itself = number[lo : lo + SHEET, None] == number[None]
                near[itself] = -np.inf
            elif own:
                here = np.flatnonzero((places >= lo) & (places < lo + len(near)))
                itself = (places[here] - lo, here)
                near[itself] = -np.inf
            if strange and own:
                odd[itself] = False
            # The k-th best of the best of GROUPS groups of columns is no better than the k-th best of all.
            some = near if len(places) < 2 * GROUPS or k > GROUPS else near[:, : len(places) // GROUPS * GROUPS].reshape(len(near), -1, GROUPS).max(1)
            floor = np.full(len(near), measure.least)
            if some.shape[1] > k:
                floor = np.maximum(floor, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k])
            hit = near >= floor[:, None] - SURE
            i, j = np.nonzero(hit | odd if strange else hit)
            i, j, score = measure.reached(a, b, i + lo, places[j])
            order = np.lexsort((j, -np.where(np.isnan(score), np.inf, score), i))
            i, j, score = i[order], j[order], score[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield a, b, i[top], j[top], score[top]

    def both(a: _Block, b: _Block, own: bool, measure: Measure) -> Iterator[tuple[_Block, _Block, np.ndarray, np.ndarray, np.ndarray]]:
        yield from best(a, b, own, measure)
        if not own:
            yield from best(b, a, own, measure)

    return both


def _met(vectors: DataFrame, measure: Measure, kernel: Callable, id_col: str, type_col: str, vector_col: str) -> DataFrame:
    """(a, b, score) that the kernel yields for each two blocks of a type. Vectors of other lengths are another type."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(type_col).alias("t"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("t").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    own = own.withColumn("n", F.size("v"))
    # At most one row for BLOCK rows of the table.
    large = own.groupBy("t", "n").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    own = own.join(F.broadcast(large), ["t", "n"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("t", "n", F.least("x", "o").alias("i"), F.greatest("x", "o").alias("j"), "x", "id", "v")
    kind = own.schema["id"].dataType

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        i, j = key[-2].as_py(), key[-1].as_py()
        with np.errstate(all="ignore"):
            a = _Block.of(rows.filter(pc.equal(rows.column("x"), i)))
            b = a if i == j else _Block.of(rows.filter(pc.equal(rows.column("x"), j)))
            if not len(a) or not len(b):
                return
            for x, y, p, q, score in kernel(a, b, i == j, measure):
                for lo in range(0, len(p), PART):
                    part = slice(lo, lo + PART)
                    yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(p[part])), y.ids.take(pa.array(q[part])), pa.array(score[part])], ["a", "b", "score"])

    found = own.groupBy("t", "n", "i", "j").applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}, score double")
    return found.where("a <> b")


def all_pairs(vectors: DataFrame, measure: Measure, id_col: str = "id", type_col: str = "type", vector_col: str = "embedding") -> DataFrame:
    """(a, b, score), a < b."""
    return _met(vectors, measure, _listed, id_col, type_col, vector_col).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def links(vectors: DataFrame, measure: Measure, id_col: str = "id", type_col: str = "type", vector_col: str = "embedding") -> DataFrame:
    """(a, b) that hang together as all_pairs do, but at most one for each row of a block and each block that it meets."""
    return _met(vectors, measure, _linked, id_col, type_col, vector_col).select("a", "b")


def nearest(vectors: DataFrame, measure: Measure, k: int, id_col: str = "id", type_col: str = "type", vector_col: str = "embedding") -> DataFrame:
    """(a, b, score) both ways round: of each a at least the k best, as its k best of each block."""
    return _met(vectors, measure, _nearest(k), id_col, type_col, vector_col)
