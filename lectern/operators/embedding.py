"""Embeddings: a cache by text, batches for what it lacks, unit vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 100
DIM = 768


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a provider: words of three letters or more, hashed into ``dim`` counts."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, x in enumerate(texts):
            for w in re.findall(r"\w{3,}", x.lower()):
                out[i, int.from_bytes(hashlib.sha256(w.encode()).digest(), "big") % dim] += 1
        return out

    return embed


def cache_key(model: str, dim: int, task: str = "document") -> str:
    return f"{model}:{dim}:{task}"


def split_by_cache(texts: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(texts with the vector that the cache has, distinct texts that it lacks)."""
    rows = texts.withColumn("lookup", F.sha2("text", 256))
    own = cache.where(F.col("key") == key).select("lookup", "vector")
    return rows.join(own, "lookup"), rows.join(own, "lookup", "left_anti").dropDuplicates(["lookup"])


class EmbeddingFailed(Exception):
    """What an embedder raises for texts that its provider does not take."""


def embed(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], key: str, skip_failures: bool = True, number: str = "float") -> DataFrame:
    """lookup, key and unit vector (null for texts that fail) of distinct texts, in batches of ``BATCH``.

    Null texts have none and are left out. ``number`` is the type of a vector's numbers, float or double.
    """
    kind = {"float": np.float32, "double": np.float64}[number]

    def vectors_of(texts: list[str]) -> list:
        v = np.asarray(embedder(texts), float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(n == 0, 1, n)).astype(kind).tolist()

    def tried(texts: list[str]) -> list:
        """A batch that is not taken is tried text by text, so that one bad text costs no other its vector."""
        try:
            return vectors_of(texts)
        except EmbeddingFailed:
            if not skip_failures:
                raise
            return [None] if len(texts) == 1 else [v for t in texts for v in tried([t])]

    def run(arrived):
        for df in arrived:
            for first in range(0, len(df), BATCH):
                part = df.iloc[first : first + BATCH]
                yield pd.DataFrame({"lookup": part["lookup"].tolist(), "key": key, "vector": tried(part["text"].tolist())})

    rows = texts if "lookup" in texts.columns else texts.withColumn("lookup", F.sha2("text", 256)).dropDuplicates(["lookup"])
    return rows.where("text IS NOT NULL").select("lookup", "text").mapInPandas(run, f"lookup string, key string, vector array<{number}>")


def embed_cached(texts: DataFrame, cache: DataFrame, embedder: Callable, key: str) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, the cache with what was new)."""
    _, misses = split_by_cache(texts, cache, key)
    fresh = embed(misses, embedder, key).where("vector IS NOT NULL")
    grown = cache.select("lookup", "key", "vector").unionByName(fresh)
    rows = texts.withColumn("lookup", F.sha2("text", 256))
    return rows.join(grown.where(F.col("key") == key).drop("key"), "lookup", "left"), grown


def checked(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Vectors, all of the given length; others are an error."""
    return vectors.where(F.coalesce(F.assert_true(F.size(column) == dim, "a vector of another length").isNull(), F.lit(True)))


def poisoned(failures: DataFrame, most: int = 3) -> DataFrame:
    """Chunks that failed so often that they are left out."""
    return failures.groupBy("chunk_id").count().where(F.col("count") >= most).select("chunk_id")
