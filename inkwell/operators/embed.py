"""Embedding of texts: a small protocol, a hashing embedder for where no model is at hand."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    identifier: str
    dimension: int

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        """Unit rows for texts; kind is `query` or `passage`."""


class HashingEmbedder:
    """Words and character triples hashed to signed positions. Deterministic, needs no model;
    it measures shared wording, not meaning."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.identifier = f"hashing-{dimension}"

    def embed(self, texts: list[str], kind: str = "passage") -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                for piece in {word, *(word[i : i + 3] for i in range(len(word) - 2))}:
                    h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
                    row[h % self.dimension] += 1 if h >> 63 else -1
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(n < 1e-9, 1, n)


class TokenMean:
    """Mean of the vectors of a text's tokens, made unit; a text without tokens gets zeros.
    vector: the vector of a token; the first `most` characters of a text count (the window of
    such a model; None for the whole text)."""

    def __init__(self, vector: Callable[[str], np.ndarray], dimension: int, identifier: str = "token-mean", most: int | None = None):
        self.vector, self.dimension, self.identifier, self.most = vector, dimension, identifier, most

    def embed(self, texts: list[str], kind: str = "passage") -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            some = [self.vector(t) for t in re.findall(r"\w+", text[: self.most])]
            if some:
                mean = np.mean(some, axis=0)
                row[:] = mean / max(float(np.linalg.norm(mean)), 1e-12)
        return out


class Prefixed:
    """An embedder that is told queries and passages apart by words in front, and reads a window
    of so many tokens of which the last stays (as encoders with an end mark do)."""

    def __init__(self, inner: Embedder, encode: Callable[[str], list], decode: Callable[[list], str], window: int = 256):
        self.inner, self.encode, self.decode, self.window = inner, encode, decode, window
        self.dimension, self.identifier = inner.dimension, f"{inner.identifier}-prefixed"

    def embed(self, texts: list[str], kind: str = "passage") -> np.ndarray:
        # The words in front.
        front = {"query": "query: ", "passage": "passage: "}[kind]
        out = []
        for text in texts:
            ids = self.encode(front + text)
            out.append(front + text if len(ids) <= self.window else self.decode(ids[: self.window - 1] + ids[-1:]))
        return self.inner.embed(out, kind)


def first_usable(*makers: Callable[[], Embedder]) -> Embedder:
    """The first embedder that can be made and gives a vector; others are fallbacks."""
    last: Exception | None = None
    for make in makers:
        try:
            e = make()
            if e is not None and e.embed(["probe"], "query").shape == (1, e.dimension):
                return e
        except Exception as x:  # a missing model file, library or device: the next one is tried
            last = x
    raise RuntimeError("no embedder is usable") from last


def embedded(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, file_id, seg, text, vec) of rows with an `input` text, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            vec = embedder.embed(t.column("input").to_pylist(), "passage")
            yield from t.drop(["input"]).append_column("vec", pa.array(list(vec), pa.list_(pa.float32()))).to_batches()

    return rows.mapInArrow(run, "chunk_id bigint, file_id bigint, seg int, text string, vec array<float>").select("chunk_id", "file_id", "seg", "text", F.col("vec"))
