"""D2 with a caller's model: texts to vectors in batches on the executors.

An `Embedder` names how to load a model and the length of its vectors.  The
model is loaded once per Python task, and called with lists of at most `batch`
texts; null texts and texts it fails on get zeros, like the reference's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.functions.dense import similarity_matrix

VECTOR = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class Embedder:
    """`load()` gives a function from a list of texts to rows of `dim` numbers."""
    load: Callable[[], Callable[[list[str]], object]]
    dim: int
    batch: int = 256

    def column(self, text: Column) -> Column:
        """array<double> of a text column."""
        load, dim, batch = self.load, self.dim, self.batch

        @F.pandas_udf(VECTOR)
        def embed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for col in columns:
                yield pd.Series(list(_embedded(model, list(col), dim, batch)))
        return embed(text)

    def best_similarities(self, texts: Column, store_bc, metric: str) -> Column:
        """array<double>: each text's best similarity to any row of the broadcast
        (store matrix, squared lengths); nulls for an empty store."""
        load, dim, batch = self.load, self.dim, self.batch

        @F.pandas_udf(VECTOR)
        def best(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for col in columns:
                yield pd.Series([None if texts is None else _best(_embedded(model, list(texts), dim, batch), store_bc.value, metric) for texts in col], dtype=object)
        return best.asNondeterministic()(texts)


def best_of_vectors(vectors: Column, store_bc, metric: str) -> Column:
    """array<double>: the best similarity of each supplied vector (array<array<double>>)."""
    @F.pandas_udf(VECTOR)
    def best(col: pd.Series) -> pd.Series:
        out = []
        for rows in col:
            dim = store_bc.value[0].shape[1]
            out.append(None if rows is None else _best(np.array([np.zeros(dim) if r is None else r for r in rows], np.float64), store_bc.value, metric))
        return pd.Series(out, dtype=object)
    return best.asNondeterministic()(vectors)


def _embedded(model, texts: list, dim: int, batch: int) -> np.ndarray:
    out = np.zeros((len(texts), dim))
    known = [i for i, t in enumerate(texts) if t is not None]
    for a in range(0, len(known), batch):
        at = known[a:a + batch]
        try:
            out[at] = np.asarray(model([texts[i] for i in at]), np.float64)
        except Exception:  # noqa: BLE001 - one text at a time, zeros for those that fail
            for i in at:
                try:
                    out[i] = np.asarray(model([texts[i]]), np.float64)[0]
                except Exception:  # noqa: BLE001
                    out[i] = 0.0
    return out


def _best(rows: np.ndarray, store: tuple[np.ndarray, np.ndarray], metric: str) -> list:
    mat, norm2 = store
    if len(mat) == 0 or len(rows) == 0:
        return [None] * len(rows)
    return similarity_matrix(rows, (rows * rows).sum(axis=1), mat, norm2, metric)[0].max(axis=1).tolist()
