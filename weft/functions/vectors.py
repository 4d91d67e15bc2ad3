"""Embedding and similarity as column expressions."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 32


_TOKEN = re.compile("[a-z0-9]+")


@lru_cache(maxsize=200_000)
def token_bucket(token: str, dimension: int = DIMENSION) -> int:
    """FNV-1a (64 bits) of a token modulo the dimension."""
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h % dimension


def _counts(texts: pd.Series, dimension: int) -> np.ndarray:
    out = np.zeros((len(texts), dimension))
    for i, t in enumerate(texts):
        for token, n in Counter(_TOKEN.findall(t.lower())).items() if t else ():
            out[i, token_bucket(token, dimension)] += n
    return out


def hash_counts(text: Column, dimension: int = DIMENSION) -> Column:
    """How many tokens (runs of a-z and 0-9 of the lower-case text) fall into each bucket; null counts as empty."""
    if dimension < 1:
        raise ValueError("dimension must be 1 or more")

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series(list(_counts(series, dimension)), dtype=object)

    return run(text)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """Bag-of-words vector of length 1; all zero for a text without ASCII letters or digits."""
    if dimension < 1:
        raise ValueError("dimension must be 1 or more")

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        out = _counts(series, dimension)
        return pd.Series(list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)), dtype=object)

    return run(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine clamped to 0..1; 0 for null, empty, all-zero vectors and those of unlike length.

    Norms may be given where one side meets many others, so that they are computed once a row.
    """
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    size = (norm(wide(a)) if norm_a is None else norm_a) * (norm(wide(b)) if norm_b is None else norm_b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / size))
    return F.when(F.coalesce(fits, F.lit(False)), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))
