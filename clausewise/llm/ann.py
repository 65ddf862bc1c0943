"""Operator 2: approximate nearest neighbours by cross-polytope hashing.

Nearness is the inner product.  A vector is scaled to unit length, padded to a power of two and rotated by
three rounds of random signs and a fast Hadamard transform.  Its bucket in a
table is the nearest signed axis.  Every row is indexed in every table; a query
probes the axes with its largest coordinates.  A bucket's rows are cut into
chunks of bounded size (a hot bucket becomes many groups), as are its queries;
each group scores its rows exactly in double precision and gives each query's k
best, merged over tables.  A query that meets fewer than k rows is compared
with all rows, in blocks.

If lengths differ, rows are indexed in bands of similar length (BAND: the longest is
at most so many times the shortest).  In a band each row first gets one more
component that levels it to the band's longest row (lengths are compared by their logarithms and vectors
scaled by their largest component first, so no finite vector overflows or vanishes), so that the largest inner
product is the smallest angle; a query probes every band.  The rows of bands with
fewer than `exact_rows` rows are compared with all queries, in blocks.

Parameters: with 14 tables and D / 8 probes (8 of 128 buckets for 64
components) recall@20 is at least 0.9 on all given tables (tests, README).

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null ids; of several vectors with one id the
smallest counts; only vectors of the query's length are candidates; ties go to
the smaller id; an inner product that overflows is infinite, one that is then no number counts as
the lowest; fewer than k candidates are all returned; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import materialise, stream64, table
from clausewise.llm.vectors import best, dealt_blocks, matrix, one_per_id

BAND = 1.1
FOUND = "query_id long, vec_id long, score double"


def hadamard(a: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two of columns)."""
    n, d = a.shape
    h = 1
    while h < d:
        a = a.reshape(n, -1, 2, h)
        a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return a


def rotated(unit: np.ndarray, tbl: int, seed: int) -> np.ndarray:
    """Pseudo-random rotation of table `tbl`, zero-padded to a power of two."""
    n, dim = unit.shape
    d = max(2, 1 << (dim - 1).bit_length())
    a = np.zeros((n, d))
    a[:, :dim] = unit
    for r in range(3):
        sign = np.where(stream64(d, seed + 1000 * tbl + r) >> np.uint64(63), 1.0, -1.0)
        a = hadamard(a * sign)
    return a


def unit_rows(vec: np.ndarray, part: np.ndarray, level: bool, query: bool) -> np.ndarray:
    """Unit vectors; with `level`, rows are scaled to `part` of the unit length
    and get the component that makes up for it (queries get 0)."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)
    vec = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    if level:
        part = np.ones(len(vec)) if query else np.minimum(part, 1.0)
        vec = np.concatenate([vec * part[:, None], np.sqrt(1.0 - part ** 2)[:, None]], axis=1)
    return vec


def buckets(rot: np.ndarray) -> np.ndarray:
    """Nearest signed axis: 2 * axis, + 1 if negative."""
    axis = np.argmax(np.abs(rot), axis=1)
    return (2 * axis + (rot[np.arange(len(rot)), axis] < 0)).astype(np.int32)


def probes(rot: np.ndarray, n: int) -> np.ndarray:
    """The n signed axes with the largest coordinates, best first."""
    d = rot.shape[1]
    signed = np.empty((len(rot), 2 * d))
    signed[:, 0::2], signed[:, 1::2] = rot, -rot
    return np.argsort(-signed, axis=1, kind="stable")[:, :n].astype(np.int32)


def _keyed(rows: DataFrame, level: bool, tables: int, n_probes: int | None, seed: int) -> DataFrame:
    """Rows (vec_id, vec, band, part) with their buckets (n_probes None) or queries with their probes:
    an array per row, exploded to (tbl, bucket)."""

    def hashed(batches):
        for batch in batches:
            ids, vecs, part_of = batch.column(0), batch.column(1), batch.column(3).to_numpy()
            dims = np.diff(vecs.offsets.to_numpy())
            keys: list[list[int]] = [[]] * len(ids)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = vecs.take(pa.array(at))
                unit = unit_rows(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim), part_of[at], level, n_probes is not None)
                cols = []
                for t in range(tables):
                    rot = rotated(unit, t, seed)
                    d = rot.shape[1]
                    got = buckets(rot)[:, None] if n_probes is None else probes(rot, min(2 * d, max(n_probes, d // 8)))
                    cols.append(got + np.int32(t * 2 * d))
                flat = np.concatenate(cols, axis=1)
                for i, row in zip(at, flat, strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([ids, vecs, batch.column(2), pa.array(keys, pa.list_(pa.int32()))], ["vec_id", "vec", "band", "keys"])

    kind = rows.schema["vec"].dataType.simpleString()
    out = rows.mapInArrow(hashed, f"vec_id long, vec {kind}, band int, keys array<int>")
    return out.select("vec_id", "vec", "band", F.size("vec").alias("dim"), F.explode("keys").alias("bucket"))


def lengths(vec: np.ndarray) -> np.ndarray:
    """Lengths of rows that hold no zero row, without squares that overflow."""
    top = np.abs(vec).max(axis=1)
    with np.errstate(over="ignore"):
        return top * np.linalg.norm(vec / top[:, None], axis=1)


def group_top_k(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Exact k best of a group's rows for each of its queries."""
    out: list[tuple] = []
    if len(rows) and len(queries):
        ids = rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vec = ids[order], matrix(rows, "vec", np.float64)[order]
        qids, qvec = queries["vec_id"].to_numpy(), matrix(queries, "vec", np.float64)
        # a product may be off by so much from the sum of its terms, in whatever order it was taken
        off = 1e-15 * vec.shape[1]
        size, qsize = lengths(vec), lengths(qvec)
        for a in range(0, len(qids), 256):
            own = ids[None, :] == qids[a:a + 256, None]
            with np.errstate(over="ignore", invalid="ignore"):
                score = qvec[a:a + 256] @ vec.T
                slack = off * qsize[a:a + 256, None] * size[None, :]
                least, most = score - slack, score + slack
            least[np.isnan(least) | own] = -np.inf
            most[np.isnan(most)] = np.inf
            cut = np.partition(least, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            for i in range(len(score)):
                at = np.flatnonzero((most[i] >= cut[i]) & ~own[i])
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (vec[at] * qvec[a + i]).sum(axis=1)  # the same sum in every group
                exact[np.isnan(exact)] = -np.inf
                pick = np.lexsort((ids[at], -exact))[:k]
                out.append((np.full(len(pick), qids[a + i], np.int64), ids[at][pick], exact[pick]))
    if not out:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": q, "vec_id": v, "score": s})


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = 14, n_probes: int = 8, chunk_rows: int = 4096, chunk_queries: int = 1024, seed: int = 11,
            exact_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score.  `is_query` is a Column over vec_id."""
    rows = one_per_id(vectors, id_col, vec_col).withColumn("top", F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).filter("top > 0")
    share = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x.cast("double") / F.col("top")) * (x.cast("double") / F.col("top")))
    rows = materialise(rows.withColumn("size", F.log("top") + F.log(share) / 2).drop("top"), "ann-rows")  # logarithm of the length
    span = rows.agg(F.min("size"), F.max("size"), F.count("*"), F.count(F.when(is_query, 1))).first()
    if not span[3]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    level, n_rows, n_queries = span[0] < span[1] - 5e-4, span[2], span[3]
    queries = rows.filter(is_query).select("vec_id", "vec")
    banded = rows.withColumn("band", F.floor((F.lit(span[1]) - F.col("size")) / F.lit(float(np.log(BAND)))).cast("int") if level else F.lit(0))
    rows = rows.select("vec_id", "vec")
    few, n_few = None, 0
    if level:
        # one row per band: at most some thousands, whatever the table
        bands = materialise(banded.groupBy("band").agg(F.max("size").alias("longest"), F.count("*").alias("n")), "ann-bands")
        banded = banded.join(F.broadcast(bands), "band").withColumn("part", F.exp(F.col("size") - F.col("longest")))
        n_few = bands.filter(F.col("n") < exact_rows).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        few = materialise(banded.filter(F.col("n") < exact_rows).select("vec_id", "vec"), "ann-few")
        banded = banded.filter(F.col("n") >= exact_rows)
    else:
        banded = banded.withColumn("part", F.lit(1.0))
    index = _keyed(banded.select("vec_id", "vec", "band", "part"), level, tables, None, seed)
    asked = _keyed(queries.select("vec_id", "vec", F.lit(0).alias("band"), F.lit(1.0).alias("part")), level, tables, n_probes, seed).drop("band")
    # bucket sizes: at most tables * 2 * D rows per vector length and band
    load = index.groupBy("dim", "band", "bucket").agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias("n_chunks"))
    ask = asked.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / F.lit(chunk_queries)).cast("int").alias("q_chunks"))
    size = materialise(load.join(ask, ["dim", "bucket"]), "ann-load")  # buckets that some query probes
    index = index.join(size, ["dim", "band", "bucket"]).select(
        "dim", "band", "bucket", F.pmod(F.xxhash64("vec_id"), F.col("n_chunks")).alias("chunk"),
        F.explode(F.expr("sequence(0, q_chunks - 1)")).alias("q_chunk"), "vec_id", "vec")
    asked = asked.join(size, ["dim", "bucket"]).select(
        "dim", "band", "bucket", F.explode(F.expr("sequence(0L, n_chunks - 1L)")).alias("chunk"),
        F.pmod(F.xxhash64("vec_id"), F.col("q_chunks")).cast("int").alias("q_chunk"), "vec_id", "vec")

    def group(a: pa.Table, b: pa.Table) -> pa.Table:
        return group_top_k(a, b, k)

    key = ["dim", "band", "bucket", "chunk", "q_chunk"]
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(group, FOUND)
    found = found.distinct()
    if n_few:
        left, right = dealt_blocks(few, queries, n_few, n_queries, chunk_rows, chunk_queries)
        found = found.unionByName(left.groupBy("rb", "qb", "dim").cogroup(right.groupBy("rb", "qb", "dim")).applyInArrow(group, FOUND))
    found = materialise(best(found, k), "ann-found")
    # queries that met fewer rows than they could: all rows, in blocks
    met = found.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias("_n"))
    short = queries.join(met, F.col("vec_id") == F.col("_q"), "left").filter(F.coalesce("_n", F.lit(0)) < min(k, n_rows - 1))
    short = materialise(short.select("vec_id", "vec"), "ann-short")
    n_short = short.count()
    if not n_short:
        return found
    left, right = dealt_blocks(rows, short, n_rows, n_short, chunk_rows, chunk_queries)
    again = left.groupBy("rb", "qb", "dim").cogroup(right.groupBy("rb", "qb", "dim")).applyInArrow(group, FOUND)
    done = found.join(short.select(F.col("vec_id").alias("_q")), F.col("query_id") == F.col("_q"), "left_anti")
    return done.unionByName(best(again, k))


def op2_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
