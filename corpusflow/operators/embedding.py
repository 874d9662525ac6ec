"""Text to vector. An embedder is a function from a text Column to an array<float> Column."""

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Column], Column]
Model = Callable[[list[str]], list]

# Texts whose words the hashing embedder counts at a time.
ROWS_AT_ONCE = 1024


def batch_embedder(load: Callable[[], Model], on_error: str = "fail") -> Embedder:
    """Embedder around a model: `load()` runs once per task, its result once per Arrow batch.

    The model maps a list of texts to a list of vectors, None where there is no vector.
    Declared non-deterministic so that Spark runs the model once per row: it would otherwise
    copy the call into every filter on the vector.

    With `on_error="null"` a batch whose call raises gets no vectors instead of ending the job: meant
    for queries, which then have no hits. A model that cannot be loaded is an error all the same.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error is fail or null")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            try:
                vectors = model([t or "" for t in texts])
            except Exception:
                if on_error == "fail":
                    raise
                vectors = [None] * len(texts)
            yield pd.Series([None if v is None else np.asarray(v, "float32") for v in vectors])

    return run.asNondeterministic()


def hashing_embedder(dim: int = 384) -> Embedder:
    """Deterministic bag-of-words feature hashing, L2-normalised; no words gives null.

    A stand-in for a served model. A word's bucket is the first 32 bits of its md5 modulo
    `dim`. The words of many texts are counted together, each distinct one hashed once; unlike
    counting (text, bucket) pairs in Spark this needs no shuffle.
    """

    def load() -> Model:
        from hashlib import md5

        def vectors(texts: list[str]) -> list:
            found: list = []
            for at in range(0, len(texts), ROWS_AT_ONCE):
                words = [t.lower().split() for t in texts[at : at + ROWS_AT_ONCE]]
                lengths = np.fromiter(map(len, words), "int64", len(words))
                code, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
                bucket = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % dim for w in distinct], "int64")
                cell = np.repeat(np.arange(len(words)), lengths) * dim + bucket[code]
                counts = np.bincount(cell, minlength=len(words) * dim).reshape(-1, dim).astype("float64")
                size = np.sqrt(np.einsum("ij,ij->i", counts, counts))
                found += [row / length if length else None for row, length in zip(counts, size)]
            return found

        return vectors

    return batch_embedder(load)


def embed(
    df: DataFrame,
    text_col: str = "chunk_text",
    embedder: Embedder | None = None,
    out_col: str = "embedding",
) -> DataFrame:
    return df.withColumn(out_col, (embedder or hashing_embedder())(F.col(text_col)))
