"""Vectors as arrays of numbers (the engine has no vector type)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """M7, summed in double in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """M6; null for null vectors and those of norm 0."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def is_finite(v: Column) -> Column:
    """P17, by row: no null, NaN or infinite part."""
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def random_unit(dim: int, seed: int) -> list[float]:
    """M19."""
    v = np.random.default_rng(seed).standard_normal(dim)
    return (v / np.linalg.norm(v)).tolist()


def hash_encoder(dim: int = 384):  # noqa: ANN201
    """V1's stand-in: unit vectors from hashed words and word pairs, the same on every machine; a model with the same
    signature can take its place. Null and empty texts give zeros."""
    import xxhash

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots: dict[str, tuple[int, float]] = {}
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dim, np.float32)
                words = (t or "").lower().replace("_", " ").split()
                for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                    if (s := slots.get(w)) is None:
                        h = xxhash.xxh64_intdigest(w)
                        s = slots[w] = (h % dim, 1.0 if h >> 63 else -1.0)
                    v[s[0]] += s[1]
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            if len(slots) > 500_000:
                slots.clear()
            yield pd.Series(out)

    return encode


def model_input(title: Column, text: Column) -> Column:
    """title with blanks, a full stop and the text's first 2,000 characters."""
    return F.concat(F.replace(title, F.lit("_"), F.lit(" ")), F.lit(". "), F.substring(text, 1, 2000))
