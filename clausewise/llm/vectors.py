"""Common preparation of vector tables (operators 2 and 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    x = F.transform(vec, lambda v: v.cast("double"))
    return F.coalesce(F.size(vec) > 0, F.lit(False)) & F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def one_per_id(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): one vector per non-null id; of several, the smallest."""
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
            .filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
            .groupBy("vec_id").agg(F.min("vec").alias("vec")))


def matrix(table: pa.Table | pa.RecordBatch, name: str, dtype) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    col = table.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def dealt_blocks(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, block_rows: int,
                 block_queries: int, least_blocks: int = 1) -> tuple[DataFrame, DataFrame]:
    """The stated query set against all rows, in blocks: both sides keyed by
    (rb, qb, dim), each row once per query block and each query once per row
    block.  A block holds a bounded number of rows and of queries."""
    nb = max(1, -(-n_rows // block_rows), min(least_blocks, -(-n_rows // 512)))
    nq = max(1, -(-n_queries // block_queries))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(nb)).cast("int")
    qsalt = F.pmod(F.xxhash64("vec_id"), F.lit(nq)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))
    every = F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    left = rows.select(salt.alias("rb"), each.alias("qb"), F.size("vec").alias("dim"), "vec_id", "vec")
    right = queries.select(every.alias("rb"), qsalt.alias("qb"), F.size("vec").alias("dim"), "vec_id", "vec")
    return left, right
