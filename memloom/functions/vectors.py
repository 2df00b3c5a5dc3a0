"""Vector similarity in built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine as a 32-bit float; 0 where lengths differ or a vector is zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).cast("float"), F.lit(0.0).cast("float"))


def distance(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - score.cast("double")))


def similarity(distance_: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance_)


def byte_histogram(text: Column) -> Column:
    """A stand-in embedding of 32 numbers: how many bytes of the UTF-8 text have each value modulo 32."""

    @F.pandas_udf("array<float>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.bincount(np.frombuffer(t, np.uint8) & 31, minlength=32).astype(np.float32) for t in texts], index=texts.index, dtype=object)

    none = F.array_repeat(F.lit(None).cast("float"), 32)
    return F.when(text.isNull(), none).otherwise(counts(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))))
