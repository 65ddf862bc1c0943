"""Operator 6: exact top-k by integer inner product over a bit-sliced index.

Components become floor(scale * x).  Rows are dealt into blocks; a block's
index holds, for every attribute, the bitmaps of its leading SLICES bits (the
low bits are quantised away, which bounds the score from both sides).  For a
query, the slices are weighted and added by carry-save bitmap arithmetic
(negative weights use complemented slices), which gives the slices of the sum.
The k-th largest sum is read from the most significant slice downward; rows
whose upper bound reaches the k-th lower bound remain and are resolved exactly
with integer products.  Blocks give their k best, merged by a window.

Blocks bound memory and every row meets every query of the stated query set.

Edge cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do null ids; of several vectors with one id the
smallest counts; only vectors of the query's length are candidates; ties go to
the smaller id; fewer than k candidates are all returned; empty tables give no
rows; other columns are ignored.  Scores must fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import materialise, n_partitions, table
from clausewise.llm.vectors import best, dealt_blocks, matrix, one_per_id

SLICES = 7


class BitSlices:
    """Bit-sliced index of an int64 matrix (rows x attributes)."""

    def __init__(self, values: np.ndarray, slices: int = SLICES):
        n, self.dim = values.shape
        self.n = n
        span = int(values.max() - values.min()) if values.size else 0
        self.low = max(0, span.bit_length() - slices)  # low bits that are quantised away
        coarse = values >> np.int64(self.low)
        self.base = int(coarse.min()) if values.size else 0
        coarse = coarse - np.int64(self.base)
        self.bits = max(1, int(coarse.max()).bit_length()) if values.size else 1
        planes = (coarse.T[:, None, :] >> np.arange(self.bits, dtype=np.int64)[None, :, None]) & 1
        self.planes = self.pack(planes.astype(bool))  # attribute x bit x word
        self.valid = self.pack(np.ones((1, n), bool))[0]

    @staticmethod
    def pack(rows: np.ndarray) -> np.ndarray:
        packed = np.packbits(rows, axis=-1, bitorder="little")
        pad = -packed.shape[-1] % 8
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], pad), np.uint8)], axis=-1)
        return np.ascontiguousarray(packed).view(np.uint64)

    def weighted_sum(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of sum |q| * (U or its complement)."""
        weight = np.abs(query)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        flip = np.where(query < 0, full, np.uint64(0))[:, None, None]
        planes = self.planes ^ flip
        top = int(weight.max()).bit_length() if len(weight) else 0
        columns: list[list[np.ndarray]] = [[] for _ in range(top + self.bits)]
        for j in range(top):
            has = np.flatnonzero((weight >> np.int64(j)) & 1)
            for b in range(self.bits):
                columns[j + b].append(planes[has, b])
        out, w = [], 0
        while w < len(columns):
            rows = columns[w]
            stack = np.concatenate(rows) if rows else np.zeros((0, planes.shape[2]), np.uint64)
            while len(stack) > 1:
                if len(columns) == w + 1:
                    columns.append([])
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                    half = a ^ b
                    columns[w + 1].append((a & b) | (half & c))
                    stack = np.concatenate([half ^ c, stack[3 * third:]])
                else:
                    a, b = stack[:1], stack[1:2]
                    columns[w + 1].append(a & b)
                    stack = a ^ b
            out.append(stack[0] if len(stack) else np.zeros(planes.shape[2], np.uint64))
            w += 1
        return out

    @staticmethod
    def kth_largest(total: list[np.ndarray], valid: np.ndarray, k: int) -> int:
        """The k-th largest sum among the valid rows, slice by slice from the top."""
        sure, equal, value, have = np.zeros_like(valid), valid.copy(), 0, 0
        for w in range(len(total) - 1, -1, -1):
            ones = equal & total[w]
            n = have + int(np.bitwise_count(ones).sum())
            if n >= k:
                equal, value = ones, value | 1 << w
            else:
                sure, have, equal = sure | ones, n, equal & ~total[w]
        return value

    @staticmethod
    def at_least(total: list[np.ndarray], valid: np.ndarray, least: int) -> np.ndarray:
        if least <= 0:
            return valid
        if least >> len(total):
            return np.zeros_like(valid)
        above, equal = np.zeros_like(valid), valid.copy()
        for w in range(len(total) - 1, -1, -1):
            if least >> w & 1:
                equal = equal & total[w]
            else:
                above, equal = above | (equal & total[w]), equal & ~total[w]
        return above | equal

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:self.n])

    def candidates(self, query: np.ndarray, k: int, without: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best: a superset, ties at the boundary included."""
        valid = self.valid
        if len(without):
            mask = np.zeros((1, self.n), bool)
            mask[0, without] = True
            valid = valid & ~self.pack(mask)[0]
        if int(np.bitwise_count(valid).sum()) <= k or not query.any():
            return self.rows(valid)
        total = self.weighted_sum(query)
        kth = self.kth_largest(total, valid, k)
        slack = int(np.abs(query).astype(object).sum()) * ((1 << self.low) - 1) >> self.low
        return self.rows(self.at_least(total, valid, kth - slack))


def block_top_k(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of one block for each query of one query block."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    if not len(rows) or not len(queries):
        return empty
    ids = rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], matrix(rows, "vec", np.int64)[order]
    index = BitSlices(values)
    out_q, out_v, out_s = [], [], []
    for qid, query in zip(queries["vec_id"].to_pylist(), matrix(queries, "vec", np.int64), strict=True):
        own = np.arange(np.searchsorted(ids, qid, "left"), np.searchsorted(ids, qid, "right"))
        at = index.candidates(query, k, own)
        score = values[at] @ query
        pick = np.lexsort((ids[at], -score))[:k]
        out_q.append(np.full(len(pick), qid, np.int64))
        out_v.append(ids[at][pick])
        out_s.append(score[pick])
    return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
                vec_col: str = "embedding", block_rows: int = 8192, block_queries: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score.  `is_query` is a Column over vec_id."""
    rows = one_per_id(vectors, id_col, vec_col)
    rows = materialise(rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))), "bits-rows")
    queries = rows.filter(is_query)
    left, right = dealt_blocks(rows, queries, rows.count(), queries.count(), block_rows, block_queries, n_partitions(rows))

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        return block_top_k(a, b, k)

    found = left.groupBy("rb", "qb", "dim").cogroup(right.groupBy("rb", "qb", "dim")).applyInArrow(
        block, "query_id long, vec_id long, score long")
    return best(found, k)


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
