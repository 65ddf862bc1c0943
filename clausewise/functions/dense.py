"""Arrow-batched numpy kernels for dense similarity (the slow path done fast).

Tokenising and hashing stay in the JVM; only the bucket ids (ints) or the
vectors cross to Python, a batch at a time, where the dot products are one
matrix product.  The store side is a bounded dimension (size-checked by the
caller) shipped once per executor as a broadcast variable.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((m * m).sum(axis=1))
    safe = np.where(n > 0, n, 1.0)
    return m / safe[:, None], (n > 0).astype(np.float64)


def similarity_matrix(q: np.ndarray, q_n2: np.ndarray, s: np.ndarray, s_n2: np.ndarray,
                      metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, distance) for all query x store pairs of one batch."""
    dots = q @ s.T
    if metric == "l2":
        d = np.maximum(q_n2[:, None] + s_n2[None, :] - 2.0 * dots, 0.0)
        return 1.0 / (1.0 + d), d
    denom = np.sqrt(q_n2)[:, None] * np.sqrt(s_n2)[None, :]
    sim = np.where(denom > 0, dots / np.where(denom > 0, denom, 1.0), 0.0)
    return sim, 1.0 - sim


CELLS = 1_000_000   # of a dense matrix (or score matrix) held at once
SLICE_TOKENS = 2_000_000   # tokens of the documents scored together


def _flat(lists: pa.Array | pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all values, rows + 1 offsets) of a list column; a null list has none."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), off


def vector_matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    flat, off = _flat(lists, np.float64)
    size = np.diff(off)
    if len(size) and size.min() != size.max():
        raise ValueError(f"vectors of {size.min()} and of {size.max()} components in one column")
    return flat.reshape(len(size), -1) if len(size) else flat.reshape(0, 0)


def bag_matrix(bags: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Bucket bags as unit-length count vectors (zero rows for empty bags)."""
    flat, off = _flat(bags, np.int64)
    return _counted(flat, off, dim)


def _counted(flat: np.ndarray, off: np.ndarray, dim: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    counts = np.bincount(rows * dim + flat, minlength=(len(off) - 1) * dim).reshape(len(off) - 1, dim)
    return unit_rows(counts.astype(np.float64))[0]


def best_similarities(flat: np.ndarray, off: np.ndarray, store: np.ndarray, store_n2: np.ndarray, dim: int, metric: str) -> np.ndarray:
    """Best similarity of each bag to any store row (NaN for an empty store), in
    slices whose vectors and scores have about CELLS cells."""
    n = len(off) - 1
    out = np.full(n, np.nan)
    step = max(1, CELLS // max(dim, len(store), 1))
    for a in range(0, n if len(store) else 0, step):
        b = min(n, a + step)
        q = _counted(flat[off[a]:off[b]], off[a:b + 1] - off[a], dim)
        out[a:b] = similarity_matrix(q, (q * q).sum(axis=1), store, store_n2, metric)[0].max(axis=1)
    return out


def dense_vectors(bags: Column, dim: int) -> Column:
    """Unit-length dense vectors of bucket bags (a null bag gives zeros): work and
    memory grow with the tokens, not with tokens x dimension."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(col: pd.Series) -> pd.Series:
        out: list = []
        step = max(1, CELLS // dim)
        for a in range(0, len(col), step):
            part = [np.zeros(0, np.int64) if b is None else np.asarray(b, np.int64) for b in col.iloc[a:a + step]]
            off = np.zeros(len(part) + 1, np.int64)
            np.cumsum([len(p) for p in part], out=off[1:])
            out += list(_counted(np.concatenate(part), off, dim))
        return pd.Series(out)
    return embed(bags)


def best_match_for_bags(bags: Column, store_bc, dim: int, metric: str) -> Column:
    """For `array<array<int>>` (bucket bags of a document's chunks) return
    `array<double>`: each chunk's best similarity to any store vector (NULL
    entries when the store is empty)."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def best(docs: pa.Array) -> pa.Array:
        store, store_n2 = store_bc.value
        docs = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
        bags = docs.flatten()
        flat, off = _flat(bags, np.int32)   # a view: no Python object per chunk or document
        chunks = np.zeros(len(docs) + 1, np.int64)
        np.cumsum(pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False), out=chunks[1:])
        sims, start = np.full(len(bags), np.nan), 0
        while start < len(docs):  # runs of documents with about SLICE_TOKENS tokens
            end = max(start + 1, int(np.searchsorted(off[chunks], off[chunks[start]] + SLICE_TOKENS)))
            end = min(end, len(docs))
            lo, hi = chunks[start], chunks[end]
            part = flat[off[lo]:off[hi]].astype(np.int64)
            sims[lo:hi] = best_similarities(part, off[lo:hi + 1] - off[lo], store, store_n2, dim, metric)
            start = end
        values = pa.array(sims, mask=np.isnan(sims))
        found = pa.ListArray.from_arrays(pa.array(chunks.astype(np.int32)), values)
        missing = docs.is_null().to_numpy(zero_copy_only=False)
        return pc.if_else(pa.array(missing), pa.scalar(None, found.type), found) if missing.any() else found

    # Marked nondeterministic (it is not) as an optimisation fence: no filter
    # is pushed below, and no projection is inlined through, the scanner stage
    # feeding it, so the scanners and the UDF run once per row.
    return best.asNondeterministic()(bags)
