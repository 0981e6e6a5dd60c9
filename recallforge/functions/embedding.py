"""Embeddings: tokens hashed into signed buckets, or an external provider."""

from __future__ import annotations

import functools
import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from recallforge.functions.text import stemmed


class EmbeddingProvider(Protocol):
    """What an embedding has to offer; it is sent to the tasks, so it opens connections lazily."""

    dimensions: int

    def embed(self, text: str) -> list[float]: ...


@functools.lru_cache(1 << 16)
def token_hash(token: str) -> int:
    """The first 60 bits of a token's MD5 sum: the same in SQL and on every machine."""
    return int(hashlib.md5(token.encode("utf-8", "replace")).hexdigest()[:15], 16)


def cosine(a: list[float], b: list[float]) -> float:
    """The dot product; 0 if lengths differ or are 0 (vectors are expected to be normalised)."""
    return float(np.dot(a, b)) if len(a) == len(b) and len(a) else 0.0


def normalised(v: np.ndarray) -> np.ndarray:
    """To length 1 by row; zero rows stay."""
    length = np.sqrt((v * v).sum(-1, keepdims=True))
    return np.divide(v, length, out=v.copy(), where=length > 0)


class HashEmbedding:
    """Each token adds +1 or -1, as its hash is even or odd, to the bucket of its hash; then length 1."""

    def __init__(self, dimensions: int = 128):
        self.dimensions = max(dimensions, 8)

    def embed_tokens(self, tokens: list[list[str]]) -> np.ndarray:
        h = np.array([token_hash(t) for words in tokens for t in words], np.int64)
        row = np.repeat(np.arange(len(tokens)), np.array([len(words) for words in tokens], np.int64))
        out = np.bincount(row * self.dimensions + h % self.dimensions, 1.0 - 2.0 * (h & 1), len(tokens) * self.dimensions)
        return normalised(out.astype(float).reshape(len(tokens), self.dimensions))

    def embed(self, text: str) -> list[float]:
        return self.embed_tokens([stemmed(text)])[0].tolist()


class FallbackEmbedding:
    """An external ``embed`` function; where it raises, the hash embedding of the same size stands in."""

    def __init__(self, call: Callable[[str], list[float]], dimensions: int = 768):
        self.call, self.dimensions, self.stand_in = call, dimensions, HashEmbedding(dimensions)

    def embed(self, text: str) -> list[float]:
        try:
            return list(self.call(text))
        except Exception:  # transport errors of any client
            return self.stand_in.embed(text)


class HttpEmbedding:
    """An embedding server's ``POST url`` of {"model", "prompt"}, which answers {"embedding": [...]}.

    ``strict`` raises where the server can't be reached, answers wrongly or with another size; else the hash embedding of
    the same size stands in, as in ``FallbackEmbedding``.
    """

    def __init__(self, url: str, model: str, dimensions: int = 768, timeout: float = 30.0, strict: bool = False):
        self.url, self.model, self.dimensions, self.timeout, self.strict = url, model, dimensions, timeout, strict
        self.stand_in = HashEmbedding(dimensions)

    def asked(self, text: str) -> list[float]:
        """What the server answers."""
        body = json.dumps({"model": self.model, "prompt": text}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.loads(answer.read())
        vector = [float(x) for x in (found.get("embedding") if isinstance(found, dict) else None) or ()]
        if len(vector) != self.dimensions:
            raise ValueError(f"{len(vector)} numbers instead of {self.dimensions}")
        return vector

    def embed(self, text: str) -> list[float]:
        try:
            return self.asked(text)
        except (OSError, ValueError, TypeError):  # not reached, or not an embedding
            if self.strict:
                raise
            return self.stand_in.embed(text)


def embed_column(provider: EmbeddingProvider) -> Callable[[Column], Column]:
    """A pandas UDF that embeds texts with ``provider``; null texts are embedded as empty ones."""

    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.fillna("").map(lambda x: list(provider.embed(x)))

    embed.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, ArrayType(DoubleType()))


def dot(a: Column, b: Column) -> Column:
    """As ``cosine``, of array columns."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), both).otherwise(0.0)
