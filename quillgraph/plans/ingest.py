"""Model calls of the ingest: extraction and embedding, with retries, and stand-ins for the models."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillgraph.schemas import EXTRACTED

Extractor = Callable[[str, list[str]], dict]
Embedder = Callable[[list[str]], list[list[float]]]


class Transient(RuntimeError):
    """A failure of a model call that may pass."""


def with_retries(call: Callable, tries: int = 3, base_s: float = 0.5):
    """call(), again after base_s, 2 * base_s ... where it fails with Transient."""
    for n in range(tries):
        try:
            return call()
        except Transient:
            if n == tries - 1:
                raise
            time.sleep(base_s * 2**n)


def stub_extractor(text: str, path: list[str]) -> dict:
    """Stands in for a model: runs of two or more capitalised words are organizations, and neighbours are related."""
    import re

    names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", text)))
    ents = [{"name": n, "type": "Organization", "aliases": [], "properties": {}, "confidence": 0.9} for n in names]
    rels = [{"source": a, "relationship": "related_to", "target": b, "properties": {}, "confidence": 0.8, "evidence": text[:120]} for a, b in zip(names, names[1:])]
    return {"entities": ents, "relationships": rels, "confidence": 0.9}


def stub_embedder(dims: int = 64) -> Embedder:
    """Stands in for a model: hashed words, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                out[i, h % dims] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def extract(chunks: DataFrame, extractor: Extractor = stub_extractor) -> DataFrame:
    """schemas.EXTRACTED of chunks; calls are made one after the other in each task and tried again where that may help. An
    extractor may tell model, input_tokens and output_tokens; if not, a token is four characters of the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"chunk_id": c, "model": None, "input_tokens": -(-len(t) // 4), "output_tokens": 0, **with_retries(lambda: extractor(t, list(p)))} for c, t, p in zip(frame["chunk_id"], frame["content"], frame["heading_path"])]
            yield pd.DataFrame(rows, columns=["chunk_id", "entities", "relationships", "confidence", "model", "input_tokens", "output_tokens"])

    return chunks.select("chunk_id", "content", "heading_path").mapInPandas(run, EXTRACTED)


def embed(rows: DataFrame, embedder: Embedder, dims: int, id_col: str, text_col: str, batch: int = 100) -> DataFrame:
    """(id, embedding) in calls of at most `batch` texts; vectors of another length than dims are an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                texts = part[text_col].tolist()
                vectors = with_retries(lambda: embedder(texts), base_s=0.2)
                if len(vectors) != len(part) or any(len(v) != dims for v in vectors):
                    raise ValueError(f"the embedder gave vectors of other than {dims} dimensions")
                yield pd.DataFrame({"id": part[id_col].to_numpy(), "embedding": vectors})

    return rows.select(id_col, text_col).mapInPandas(run, "id string, embedding array<float>")
