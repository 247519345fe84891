"""Embedders: the port, and a deterministic one made of hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quern.errors import EmbeddingMismatch


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Words hashed to signed places, summed and brought to length 1; texts that
    share words are near.  No text gives a zero vector but the empty one."""

    def __init__(self, dimensions: int = 64):
        if dimensions < 1:
            raise EmbeddingMismatch("dimensions must be 1 at least")
        self.name, self.dimensions = f"hash-{dimensions}", dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions), np.float64)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                d = hashlib.sha512(word.encode()).digest()
                seed = np.frombuffer((d * (self.dimensions // 64 + 1))[: self.dimensions], np.uint8)
                out[i] += seed / 127.5 - 1
            size = np.linalg.norm(out[i])
            if size:
                out[i] /= size
        return out.astype(np.float32).tolist()


def embed(chunks: DataFrame, embedder: Embedder, id_: str = "id", body: str = "body", batch: int = 64) -> DataFrame:
    """(chunk_id, embedding) in batches; a wrong count or width ends the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                rows = part.iloc[a : a + batch]
                got = embedder.embed(rows[body].fillna("").tolist())
                if len(got) != len(rows) or any(len(v) != embedder.dimensions for v in got):
                    raise EmbeddingMismatch(f"{embedder.name} returned other vectors than asked for")
                yield pd.DataFrame({"chunk_id": rows[id_].to_numpy(), "embedding": got})

    kind = chunks.schema[id_].dataType.simpleString()
    return chunks.select(id_, body).mapInPandas(run, f"chunk_id {kind}, embedding array<float>")
