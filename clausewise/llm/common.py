"""Shared helpers of the training-data operators.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D).
Arrow string batches are hashed as byte buffers with numpy, in slices of a
bounded number of bytes (one document is never cut).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.session import checkpoint_dir

SLICE_BYTES = 2_000_000
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as parquet in the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, is scanned column-wise."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, ...]:
    """(`df` with its columns named c0, c1, ..., the new name of each of
    `names`): internal columns then clash with none of the caller's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), *[f"c{df.columns.index(n)}" for n in names]


def restored(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns c0, c1, ... under their first names, without others."""
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def n_partitions(df: DataFrame) -> int:
    """Shuffle width of the session (grows with the cluster's setting)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words_expr(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), on wrapping uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 values, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003 & MASK64)) * np.uint64(0x9E3779B97F4A7C15))


def text_slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit`
    bytes; nulls have no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    large = pa.types.is_large_string(arr.type)
    if not large and not pa.types.is_string(arr.type):
        arr = arr.cast(pa.string())
    if len(arr) == 0:
        return
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if large else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(arr):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start bytes, end bytes, first word of each row + total) of all words."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ink = ~_SPACE[data]
    head = ink.copy()
    head[1:] &= ~ink[:-1]
    tail = ink.copy()
    tail[:-1] &= ~ink[1:]
    cuts = off[(off > 0) & (off < n)]
    head[cuts] = ink[cuts]
    tail[cuts - 1] = ink[cuts - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, off, side="left")


_TABLE = stream64(64 * 256, 7)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a random table value per (place, byte), summed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    byte = data[place + np.repeat(starts, length)]
    with np.errstate(over="ignore"):
        value = _TABLE[((place & 63) << 8) + byte]
        far = place >> 6
        if far.any():
            value = value * (2 * far.astype(np.uint64) + np.uint64(1))
        return mix64(np.add.reduceat(value, first) + length.astype(np.uint64))


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs inside a row, and the first run of each row
    + total.  A row of 1 to k-1 words has one run: all of its words."""
    n = np.diff(first)
    coef = stream64(k, 100 + seed) | np.uint64(1)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    if at[-1] == 0:
        return np.zeros(0, np.uint64), at
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(at[-1]) - at[row] + first[row]
    with np.errstate(over="ignore"):
        total = np.zeros(at[-1], np.uint64)
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        short = n[row] < k
        for j in range(k):
            part = padded[start + j] * coef[j]
            if short.any():
                part = np.where(short & (j >= n[row]), np.uint64(0), part)
            total += part
        return mix64(total + np.uint64(k) - short.astype(np.uint64)), at


class Groups:
    """Rows of key-sorted Arrow batches, given out one key at a time.

    Only the rows of the current key are held; the caller bounds a key's rows
    (buckets and blocks are split before)."""

    def __init__(self, key: str):
        self.key = key

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(batch.schema.get_field_index(self.key)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and keys[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        if held:
            yield pa.Table.from_batches(held)
