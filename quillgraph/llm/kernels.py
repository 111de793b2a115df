"""Array kernels over the texts of an Arrow batch: bytes, words and their hashes, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
#: Bytes that are worked on at once, so that an array of hashes stays a few MB.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    """1, b, b*b ... modulo 2**64, n of them."""
    out = np.full(n, _BASE, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run without ASCII white space, and the first word of each text (and one past all)."""
    solid = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U)
    size = ends - starts
    cuts = np.searchsorted(np.cumsum(size), np.arange(PIECE, int(size.sum()) + PIECE, PIECE), "right") if len(starts) else []
    lo = 0
    for hi in [*np.unique(cuts), len(starts)]:
        if hi <= lo:
            continue
        n = size[lo:hi]
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        inner = np.arange(int(n.sum())) - np.repeat(first, n)
        value = (data[inner + np.repeat(starts[lo:hi], n)].astype(U) + U(1)) * powers(int(n.max()))[inner]
        out[lo:hi] = mix(np.add.reduceat(value, first) + n.astype(U))
        lo = hi
    return out


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring values."""
    if len(values) < k:
        return np.zeros(0, U)
    p = powers(k)[::-1]
    out = np.zeros(len(values) - k + 1, U)
    for j in range(k):
        out += values[j : j + len(out)] * p[j]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: max(0, len(values) - step)], values[step:])
        have += step
    return values


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `limit` bytes at most; a longer text stands alone."""
    sizes = np.frombuffer(pa.compute.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes(), np.int64)
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > limit:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)
    give_back()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries than glibc
    _trim = None


def give_back() -> None:
    """Returns memory that a batch no longer needs to the system: Spark keeps Python workers for the tasks and stages to come."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
