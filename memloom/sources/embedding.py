"""Embeddings of texts by a function from a list of texts to a list of vectors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> Callable:
    """A column function; embed is called with at most batch texts and must return as many vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            for i in range(0, len(texts), batch):
                part = texts.iloc[i : i + batch].fillna("").tolist()
                vectors = embed(part)
                if len(vectors) != len(part):
                    raise ValueError("the embedder returned another number of vectors")
                out += vectors
            yield pd.Series(out, index=texts.index)

    return run
