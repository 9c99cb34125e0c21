"""The embedder registry: how chunk texts and questions become unit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@runtime_checkable
class Embedder(Protocol):
    name: str
    dim: int
    max_batch: int
    normalized: bool
    max_seq_tokens: int | None

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...
    def embed_query(self, text: str) -> np.ndarray: ...
    def describe(self) -> dict: ...


_known: dict[str, Callable[..., Embedder]] = {}


def register(name: str):
    """Decorator: an embedder under a name of its own."""

    def add(make):
        if name in _known:
            raise ValueError(f"there is an embedder {name} already")
        _known[name] = make
        return make

    return add


def get(name: str, **options) -> Embedder:
    if name not in _known:
        raise KeyError(f"no embedder {name}; there are {sorted(_known)}")
    return _known[name](**options)


def batches(texts: list[str], most: int, tokens: int | None = None) -> Iterator[list[str]]:
    """Batches under a count and, if given, an estimate of a token to three characters; a text over it goes alone."""
    held, size = [], 0
    for t in texts:
        n = len(t) // 3 + 1
        if held and (len(held) == most or tokens and size + n > tokens):
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


@register("hashing")
class Hashing:
    """Deterministic stand-in for a model: signed hashes of words, summed and scaled to length one."""

    def __init__(self, dim: int = 64, max_batch: int = 256, max_seq_tokens: int | None = None, prefix: str = "") -> None:
        self.name, self.dim, self.max_batch, self.normalized, self.max_seq_tokens, self.prefix = "hashing", dim, max_batch, True, max_seq_tokens, prefix

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split() or [""]:
                h = hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % self.dim] += 1.0 if h[4] & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out[norm[:, 0] == 0, 0] = 1.0
        return out / np.where(norm == 0, 1, norm)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([self.prefix + text])[0]

    def describe(self) -> dict:
        return {"provider": "hashing", "model": f"hashing-{self.dim}", "dim": self.dim, "normalized": True, "max_seq_tokens": self.max_seq_tokens}


def embed(chunks: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``chunks`` with their ``embedding``; the model is made once a task."""
    options = options or {}

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = get(name, **options)
        for texts in parts:
            found = [v for some in batches(texts.fillna("").tolist(), model.max_batch) for v in np.asarray(model.embed_documents(some), np.float32)]
            if len(found) != len(texts) or any(v.shape != (model.dim,) for v in found):
                raise ValueError(f"{model.name} gave vectors of another number or width than asked for")
            yield pd.Series([v.tolist() for v in found], dtype=object)

    return chunks.withColumn("embedding", vectors(F.col("text")))
