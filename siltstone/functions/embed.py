"""Embedding texts: a provider interface, and a deterministic provider that needs no model. [VEC-1, VEC-2, VEC-4, VEC-5]"""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import trim_to_budget
from siltstone.operators.vector import valid_vector
from siltstone.runtime import ship


class Provider(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def _pieces(word: str, size: int) -> list[tuple[int, float]]:
    """Place and signed weight of a word and of each of its three-letter pieces."""
    out = []
    for piece, weight in [(word, 1.0), *((word[i : i + 3], 0.3) for i in range(len(word) - 2))]:
        h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "big")
        out.append((h % size, weight if h >> 63 else -weight))
    return out


#: Short words' pieces, in bounded memory.
_remembered = lru_cache(maxsize=50_000)(_pieces)


class HashingProvider:
    """Signed hashing of words and of their three-letter pieces, L2-normalised: texts that share names are near each other."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.size
        words = re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", text).lower())
        for w in words:
            for at, weight in _remembered(w, self.size) if len(w) <= 32 else _pieces(w, self.size):
                out[at] += weight
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else [1.0, *out[1:]]


class HttpProvider:
    """A model server with ``POST /api/embed`` {model, input} -> {embeddings}. Texts that overflow the context are retried at 0.9
    and 0.75 of it. A server that doesn't know this address is asked text by text at ``/api/embeddings`` {model, prompt}."""

    def __init__(self, url: str, model: str, size: int, context: int = 512, timeout: float = 15.0):
        self.url, self.model, self.size, self.context, self.timeout = url.rstrip("/"), model, size, context, timeout

    def _post(self, address: str, **body: object) -> dict:
        sent = json.dumps({"model": self.model, **body, "options": {"num_ctx": self.context}}).encode()
        request = urllib.request.Request(f"{self.url}{address}", sent, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def embed(self, texts: list[str]) -> list[list[float]]:
        for share in (1.0, 0.9, 0.75):
            sent = texts if share == 1.0 else [trim_to_budget(t, max(16, int(self.context * share))) for t in texts]
            try:
                got = self._post("/api/embed", input=sent)["embeddings"]
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return [self._post("/api/embeddings", prompt=t)["embedding"] for t in texts]
                if share == 0.75:
                    raise
                continue
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} embeddings for {len(texts)} texts")
            return got
        raise RuntimeError("unreachable")


def embed(rows: DataFrame, provider: Provider, *, text_col: str = "content", vector_col: str = "embedding", batch: int = 8, token_budget: int = 0) -> DataFrame:
    """``rows`` with an embedding, in Arrow batches; a partition is one worker. Invalid vectors become null."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = [trim_to_budget(t or "", token_budget) if token_budget else t or "" for t in texts]
            out: list[list[float]] = []
            for start in range(0, len(given), batch):
                out += provider.embed(given[start : start + batch])
            yield pd.Series(out)

    made = rows.withColumn(vector_col, run(F.col(text_col)))
    return made.withColumn(vector_col, F.when(valid_vector(F.col(vector_col), provider.size), F.col(vector_col)))


Embedder = Callable[[list[str]], list[list[float]]]
