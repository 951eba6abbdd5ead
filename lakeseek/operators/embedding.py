"""Dense vectors from a given embedder, and the guards that keep a collection to one model."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.operators.retrieve import vocabulary_text

Embedder = Callable[[list[str]], list[list[float]]]


class DimensionMismatch(ValueError):
    """The stored vectors have another length than the embedder's."""


class ModelMismatch(ValueError):
    """The collection was embedded with another model."""


def hashed_words(dimension: int = 64) -> Embedder:
    """An embedder without a model: words are hashed into signed buckets, vectors have length 1."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out
    return embed


def embed(points: DataFrame, embedder: Embedder, batch: int = 256) -> DataFrame:
    """vec_id, collection, embedding of every point, in Arrow batches; the embedder sees up to ``batch`` texts at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            vectors = [v for at in range(0, len(texts), batch) for v in embedder(texts[at:at + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.list_(pa.float32()))], ["vec_id", "collection", "embedding"])
    kind = points.schema["point_id"].dataType.simpleString()
    return points.select("point_id", "collection", vocabulary_text().alias("text")).mapInArrow(run, f"vec_id {kind}, collection string, embedding array<float>")


def check_dimension(vectors: DataFrame, dimension: int) -> None:
    """Refuse to go on if any stored vector is known to have another length."""
    other = vectors.where(F.size("embedding") != dimension).select(F.size("embedding").alias("n")).first()
    if other is not None:
        raise DimensionMismatch(f"stored vectors have {other['n']} values, the embedder gives {dimension}")


def check_model(stored: str | None, current: str | None) -> bool:
    """Whether the stored name has to be filled in; a definite mismatch is refused."""
    if stored and current and stored != current:
        raise ModelMismatch(f"the collection was made with {stored!r}, not {current!r}")
    return bool(current) and not stored
