"""Language identification: blended-spectrum presence kernels, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.kernels import PIECE, slices, text_bytes

#: Byte n-grams whose presence makes up the spectrum, and the number of slots they are hashed to.
ORDERS = (2, 3, 4)
SLOTS = 1 << 13
#: A text is scored in stretches of so many bytes, which leave most slots empty, and so many stretches at a time.
STRETCH, AT_ONCE = 4096, 512
#: Most texts of a language that are learned from, stretches of such a text, and landmarks of a language.
SAMPLE, STRETCHES, LANDMARKS = 200, 4, 32
#: With more languages each has fewer texts, to about so many in all but LEAST_TEXTS each, and fewer landmarks, but one.
TEXTS_IN_ALL, LEAST_TEXTS, LANDMARKS_IN_ALL = 12_800, 8, 2048

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def presence(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """texts x SLOTS: whether any n-gram of the text hashes to the slot. Works on a piece of bytes at a time. ends: how far
    the n-grams that begin in each text may reach, if beyond it."""
    ends = offsets[1:] if ends is None else ends
    out = np.zeros((len(offsets) - 1) * SLOTS, bool)
    for lo in range(0, len(data), PIECE):
        hi = min(len(data), lo + PIECE + max(ORDERS) - 1)
        edges = np.clip(offsets, lo, hi) - lo
        size = np.diff(edges)
        row = np.repeat(np.arange(len(size), dtype=np.int64) * SLOTS, size)
        left = np.repeat(np.minimum(ends, hi) - lo, size) - np.arange(hi - lo)
        code = folded = _FOLD[data[lo:hi]].astype(np.uint32)
        for n in range(2, max(ORDERS) + 1):
            code = code[: max(0, hi - lo - n + 1)] * np.uint32(257) + folded[n - 1 :]
            if n in ORDERS:
                slot = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int64)
                out[(row[: len(code)] + slot)[left[: len(code)] >= n]] = True
    return out.reshape(-1, SLOTS)


def stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place in it from 0 to 1, bytes, presence) of stretches of the texts, AT_ONCE of them at a time. Each n-gram
    belongs to the stretch in which it begins; an empty text is one stretch."""
    count = np.maximum(1, -(-np.diff(offsets) // STRETCH))
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    edges = np.append(offsets[:-1][text] + nth * STRETCH, offsets[-1])
    for lo in range(0, len(text), AT_ONCE):
        own = text[lo : lo + AT_ONCE]
        first, last = edges[lo], edges[lo + len(own)]
        # What n-grams of the last stretch reach into is a row of its own, and left out.
        reach = min(last + max(ORDERS) - 1, len(data))
        rows = np.append(edges[lo : lo + len(own) + 1], reach) - first
        found = presence(data[first:reach], rows, np.append(offsets[1:][own] - first, rows[-1]))[:-1]
        yield own, nth[lo : lo + len(own)] / np.maximum(count[own] - 1, 1), np.diff(rows)[:-1], found


def spectrum(p: np.ndarray) -> np.ndarray:
    """Presence divided by its length, so that a product of two rows is the normalised count of n-grams they share."""
    x = p.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


@dataclass
class Model:
    """landmarks: landmarks x SLOTS, their spectra. weights: landmarks (and one constant) x languages. typical: SLOTS x
    languages, how much likelier a slot is in the language than any slot, as a logarithm. least: a text of the language is
    this typical at least, on the mean of its slots."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    typical: np.ndarray
    least: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks.T) @ self.weights[:-1] + self.weights[-1]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages: the scores, and by how much the text is more typical than the least; both are means over all
        stretches of a text."""
        n, k = len(offsets) - 1, len(self.languages)
        score, typical, size, slots = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, 1)), np.zeros((n, 1))
        for text, _, length, p in stretches(data, offsets):
            weight = np.maximum(length, 1)[:, None]
            np.add.at(score, text, self.scores(spectrum(p)) * weight)
            np.add.at(size, text, weight)
            np.add.at(typical, text, p.astype(np.float32) @ self.typical)
            np.add.at(slots, text, p.sum(1, keepdims=True))
        return score / size, np.where(slots > 0, typical / np.maximum(slots, 1) - self.least, 0)


def _typical(count: np.ndarray, n: int, fill: float) -> np.ndarray:
    """Logarithm of how often a slot was seen in n stretches, against the mean of all slots."""
    return np.log((count + fill / 2) / (n + 0.5) / fill)


def fit(bits: np.ndarray, y: list[str], per_language: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """Ridge regression of +1 / -1 for each language on the Nystrom features of the landmarks, the first rows of each
    language; every language weighs the same, however often it is seen. bits: packed rows of presence.

    The least typicality of a language lies halfway between that of random slots and the median of its own rows, each
    left out of the counts that it is held against. It depends on that language's texts alone."""
    languages = sorted(set(y))
    number = {lang: i for i, lang in enumerate(languages)}
    label = np.array([number[v] for v in y])
    at = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
    rows = lambda own: np.unpackbits(bits[own], axis=1)
    marks = spectrum(rows(np.concatenate([own[: max(1, min(per_language, LANDMARKS_IN_ALL // len(languages)))] for own in at])))
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    root[:, value < 1e-6] = 0
    weight = 1 / np.bincount(label)[label]
    left, right = np.zeros((len(root) + 1, len(root) + 1)), np.zeros((len(root) + 1, len(languages)))
    for lo in range(0, len(y), AT_ONCE):
        own = np.arange(lo, min(lo + AT_ONCE, len(y)))
        z = np.hstack([(spectrum(rows(own)) @ marks.T) @ root, np.ones((len(own), 1))])
        weighed = (z * weight[own, None]).T
        left += weighed @ z
        right += weighed @ np.where(label[own, None] == np.arange(len(languages))[None], 1.0, -1.0)
    w = np.linalg.solve(left + ridge * len(languages) / len(y) * np.eye(len(left)), right)
    typical, least = np.zeros((SLOTS, len(languages)), np.float32), np.zeros(len(languages))
    for i, own in enumerate(at):
        parts = [own[lo : lo + AT_ONCE] for lo in range(0, len(own), AT_ONCE)]
        count = sum(rows(part).sum(0, dtype=np.int64) for part in parts)
        fill = max(count.sum() / len(own) / SLOTS, 1 / SLOTS)
        typical[:, i] = _typical(count, len(own), fill)
        others = _typical(np.maximum(count - 1, 0), len(own) - 1, fill).astype(np.float32)
        without = np.concatenate([(p @ others) / np.maximum(p.sum(1), 1) for p in (rows(part).astype(np.float32) for part in parts)])
        least[i] = (typical[:, i].mean() + np.median(without)) / 2
    return Model(languages, marks, np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32), typical, least)


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            lang = part.column("lang").cast(pa.string())
            data, offsets = text_bytes(part.column("text"))
            count = np.maximum(1, -(-np.diff(offsets) // STRETCH))
            for text, place, _, p in stretches(data, offsets):
                # Of a long text, the first and the last stretch and those spread between them.
                nth, last = np.rint(place * np.maximum(count[text] - 1, 1)), np.maximum(count[text] - 1, 1)
                wanted = np.any([nth == np.rint(i * last / (STRETCHES - 1)) for i in range(STRETCHES)], axis=0)
                bits = np.packbits(p[wanted], axis=1)
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(text[wanted])), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "bits"])


def learn(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fits on all languages, on at most `sample` texts of each that aren't held out, chosen by hash of doc_id, and on a
    few stretches of a long one. None if there is nothing to learn from."""
    seen = docs.select(F.col(doc_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    seen = seen.where(F.col("lang").isNotNull() & ~held_out(F.col("_id")) & F.col("text").rlike(r"\p{L}"))
    seen = seen.withColumn("_t", F.xxhash64("text"))
    ids = seen.select("_id", "lang", "_t", F.xxhash64("_id").alias("_h"))
    first = ids.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_id", "_t"))).where(F.col("_n") <= sample)
    first = first.groupBy("_id", F.col("lang").alias("_l"), F.col("_t").alias("_t2")).agg(F.min("_n").alias("_n"))
    # What is collected grows with the languages alone: TEXTS_IN_ALL texts, or LEAST_TEXTS of each if that is more.
    languages = first.select("_l").distinct().count()
    if languages * sample > TEXTS_IN_ALL:
        first = first.where(F.col("_n") <= max(LEAST_TEXTS, TEXTS_IN_ALL // languages))
    first = first.withColumnRenamed("_id", "_id2")
    own = seen.join(F.broadcast(first), (F.col("_id") == F.col("_id2")) & (F.col("lang") == F.col("_l")) & (F.col("_t") == F.col("_t2")))
    own = own.dropDuplicates(["_id", "lang", "_t"])  # rows that repeat a document are one text
    rows = own.select("text", "lang").mapInArrow(_packed, "lang string, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    order = np.random.default_rng(5).permutation(len(rows))
    bits = np.frombuffer(b"".join(bytes(rows[i]["bits"]) for i in order), np.uint8).reshape(len(rows), -1)
    return fit(bits, [rows[i]["lang"] for i in order])


def predict(docs: DataFrame, model: Model | None, doc_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_col, the columns in keep, lang_pred, score and known per row of docs, from the whole text alone.

    score, from 0 to 1, is the winner's share of the exponentials of the scores. known: whether the text is typical enough
    of any learned language, however many there are; a text of one byte has nothing to judge by and is.
    Null texts and those without a letter are `und` with score 0 and not known, as is all if nothing was learned; ties between
    languages go to the first by name; repeated rows get equal answers; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "_text", 1 << 19):
                names, score, known = [None] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                if m is not None and part.num_rows:
                    s, typical = m.judge(*text_bytes(part.column("_text")))
                    known = (typical >= 0).any(1)
                    best = s.argmax(1)
                    share = np.exp(4 * (s - s.max(1, keepdims=True)))
                    score = (1 / share.sum(1)).astype(float)
                    names = [m.languages[i] for i in best]
                ok = part.column("_letter").to_numpy(zero_copy_only=False).astype(bool) & (m is not None)
                pred = [n if o else "und" for n, o in zip(names, ok)]
                yield pa.RecordBatch.from_arrays([part.column("_keep"), pa.array(pred, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(known & ok)], ["_keep", "lang_pred", "score", "known"])

    own = docs.select(F.struct(F.col(doc_col), *(F.col(c) for c in keep if c != doc_col)).alias("_keep"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = own.select("_keep").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "known": F.lit(False)}).schema
    return own.mapInArrow(run, schema).select("_keep.*", "lang_pred", "score", "known")
