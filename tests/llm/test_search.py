"""Operators 2 and 6 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.llm.ann import hadamard, nearest, op2_ann
from clausewise.llm.bitslice import BitSlices, exact_top_k, op6_topk
from clausewise.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score string"
SF = "/root/testdata/sf0.001"


def rows_of(vecs):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7, "x") for i, v in vecs]


def brute(vecs, queries, k, dtype=float):
    out = {}
    for q in queries:
        scored = sorted((-(np.asarray(vecs[q], dtype) * np.asarray(v, dtype)).sum(), i) for i, v in vecs.items()
                        if i != q and len(v) == len(vecs[q]))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def got_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_slices_select_a_superset_of_the_best():
    rng = np.random.default_rng(5)
    for span in (3, 200, 100_000):
        values = rng.integers(-span, span, size=(700, 9))
        index = BitSlices(values)
        for q in (values[0], rng.integers(-span, span, size=9), np.zeros(9, np.int64), -np.abs(values[3])):
            score = values @ q
            order = np.lexsort((np.arange(700), -score))
            order = order[order != 0][:10]
            assert set(order) <= set(index.candidates(q, 10, np.array([0])))


def test_slices_drop_most_rows():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 64))
    values = np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    index = BitSlices(values)
    assert np.mean([len(index.candidates(values[i], 10, np.array([i]))) for i in range(5)]) < 1000


@pytest.mark.parametrize("block_rows,block_queries", [(8192, 1024), (13, 3)])
def test_exact_top_k_equals_brute_force(spark, block_rows, block_queries):
    rng = np.random.default_rng(1)
    vecs = {i: rng.integers(-4, 5, size=6) / 8 for i in range(90)}  # many ties
    df = spark.createDataFrame(rows_of(vecs.items()), SCHEMA)
    got = got_of(exact_top_k(df, F.col("vec_id") % 10 == 0, 10, block_rows=block_rows, block_queries=block_queries))
    quantised = {i: [math.floor(1024 * x) for x in v] for i, v in vecs.items()}
    assert got == brute(quantised, range(0, 90, 10), 10, np.int64)


def test_edge_vectors(spark):
    bad = [(None, [1.0, 1.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]
    good = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), (20, [0.25, 0.5]), (40, [0.0, 0.0]), (60, [-1.0, 2.0]), (80, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows_of(bad + good), SCHEMA)
    got = got_of(exact_top_k(df, F.col("vec_id") % 20 == 0, 10))
    assert [i for i, _ in got[0]] == [60, 20, 40] and 80 not in got  # fewer than k: all; no row of its length
    near = got_of(nearest(df, F.col("vec_id") % 20 == 0, 10))
    assert [i for i, _ in near[0]] == [60, 20] and 40 not in near  # zero vectors take no part
    empty = df.filter("vec_id = -1")
    assert exact_top_k(empty, F.lit(True)).count() == 0 and nearest(empty, F.lit(True)).count() == 0


def test_hadamard_keeps_angles():
    a = np.random.default_rng(2).normal(size=(5, 16))
    b = hadamard(a)
    assert np.allclose(b @ b.T, 16 * a @ a.T)


def test_nearest_scores_are_exact_and_groups_do_not_matter(spark):
    rng = np.random.default_rng(3)
    vecs = {i: rng.normal(size=16) * (1 + i % 3) for i in range(300)}  # unequal lengths
    df = spark.createDataFrame(rows_of(vecs.items()), SCHEMA)
    got = got_of(nearest(df, F.col("vec_id") % 20 == 0, 20))
    small = got_of(nearest(df, F.col("vec_id") % 20 == 0, 20, chunk_rows=7, chunk_queries=2))
    assert got == small
    want = brute(vecs, range(0, 300, 20), 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert len(found) == 20
        assert all(s == (vecs[q] * vecs[i]).sum() for i, s in found)


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(8)
    scale = {0: 1e160, 1: 1e-170, 2: 5e-324, 3: 1e307, 4: 1.0, 5: 1e-160}
    vecs = {i: np.sign(rng.normal(size=8)) * scale[i % 6] * (1 if i % 6 == 2 else 1 + i % 5 / 4) for i in range(60)}
    df = spark.createDataFrame(rows_of(vecs.items()), SCHEMA)
    for exact_rows in (2048, 1):
        got = got_of(nearest(df, F.col("vec_id") % 5 == 0, 20, exact_rows=exact_rows, n_probes=16))
        assert set(got) == set(range(0, 60, 5))
        for q, found in got.items():
            with np.errstate(over="ignore", invalid="ignore"):
                score = {i: (vecs[q] * v).sum() for i, v in vecs.items() if i != q}
            low = {i: -math.inf if math.isnan(x) else x for i, x in score.items()}
            want = sorted(low.items(), key=lambda x: (-x[1], x[0]))[:20]
            assert len(found) == 20 and all(low[i] == s for i, s in found)
            if exact_rows == 2048:  # all bands are small: compared with all rows
                assert found == want


def test_equal_scores_at_the_cut(spark):
    vecs = {i: np.array([1.0, i % 3, 0.0]) for i in range(50)}
    got = got_of(nearest(spark.createDataFrame(rows_of(vecs.items()), SCHEMA), F.col("vec_id") % 20 == 0, 20))
    assert got == brute(vecs, (0, 20, 40), 20)


def test_few_rows_are_all_returned(spark):
    rng = np.random.default_rng(4)
    vecs = {i: rng.normal(size=32) for i in range(15)}
    got = got_of(nearest(spark.createDataFrame(rows_of(vecs.items()), SCHEMA), F.col("vec_id") == 0, 20))
    assert len(got[0]) == 14


@pytest.mark.parametrize("lengths", ["one long", "lognormal"])
def test_recall_with_unequal_lengths(spark, lengths):
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(4000, 64))
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    vec *= np.where(np.arange(4000) == 7, 10.0, 1.0)[:, None] if lengths == "one long" else rng.lognormal(0, 0.5, 4000)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vec.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 40 == 0, exact_rows=100).collect():  # most bands are hashed
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 40):
        score = vec @ vec[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    print("recall", lengths, hits / 2000)
    assert len(got) == 100 and hits >= 0.9 * 2000


def test_recall_on_given_table(spark):
    e = table(spark, SF, "embeddings").collect()
    vecs = {r.vec_id: np.array(r.embedding, float) for r in e}
    got = got_of(op2_ann(spark, SF))
    want = brute(vecs, [i for i in vecs if i % 20 == 0], 20)
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    exact = got_of(op6_topk(spark, SF))
    quantised = {i: np.floor(1024 * v).astype(np.int64) for i, v in vecs.items()}
    assert exact == brute(quantised, [i for i in vecs if i % 100 == 0], 10, np.int64)
