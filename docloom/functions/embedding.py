"""Vectors for texts through a provider: any callable from a list of texts to a list of vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[list[float]]]


def hashed_words(dim: int = 64) -> Provider:
    """A deterministic provider without a model: signed word counts in ``dim`` buckets."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word in re.findall(r"[㐀-鿿]|\w+", text.lower()):
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                row[h % dim] += 1 if h >> 31 else -1
        return out.tolist()

    return embed


def embed(text: Column, provider: Provider, batch: int = 16) -> Column:
    """Unit vectors (array<float>) of texts, ``batch`` at a time; null for null or blank texts and for
    answers without length. A wrong number of answers fails the task."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and t.strip()]
        for start in range(0, len(asked), batch):
            some = asked[start : start + batch]
            vectors = provider([texts.iloc[i] for i in some])
            if len(vectors) != len(some):
                raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
            for i, v in zip(some, np.asarray(vectors, np.float64)):
                n = np.linalg.norm(v)
                out[i] = (v / n).astype(np.float32) if np.isfinite(n) and n > 0 else None
        return pd.Series(out, dtype=object)

    return run(text)


def missing(chunks: DataFrame, provider: Provider) -> DataFrame:
    """Chunks without a vector (dimension 0) with one; the others are not sent to the provider."""
    lacking = chunks.where("embedding is null or embedding_dim = 0").withColumn("embedding", embed(F.col("content"), provider))
    lacking = lacking.withColumn("embedding_dim", F.coalesce(F.size("embedding"), F.lit(0)).cast("long"))
    return lacking.withColumn("embedding_dim", F.when(F.col("embedding").isNull(), 0).otherwise(F.col("embedding_dim")))
