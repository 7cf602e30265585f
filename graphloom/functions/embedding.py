"""Embedders: a protocol, a deterministic one for tests, and use of any on a column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Turns texts into vectors of one dimension; must pickle to executors."""

    dim: int

    def embed_many(self, texts: list[str]) -> np.ndarray: ...

    def embed(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Words hashed to signed dimensions, scaled to length 1.

    It has no notion of meaning and stands in for a trained model in tests.
    """

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed_many(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
            size = np.linalg.norm(row)
            if size:
                row /= size
        return out

    def embed(self, text: str) -> list[float]:
        return self.embed_many([text])[0].tolist()


def embedded(text: Column, embedder: Embedder) -> Column:
    """Vectors of a column of texts, in Arrow batches; the embedder is unpickled once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed_many(texts.fillna("").tolist())))

    return run(text)
