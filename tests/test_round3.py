"""Findings of round 3: rows dealt for heavy work, searches, history, stores, candidates."""

import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewise.functions.dense import best_match_for_bags
from clausewise.functions.vectors import DEFAULT_DIM
from clausewise.llm import collocations, jaccard
from clausewise.operators.vectors import _kth_bound, top_k_similar
from clausewise.plans import audit as A
from clausewise.plans import catalog
from clausewise.session import HEAVY_ROWS, checkpoint_dir, dealt
from clausewise.sources import vector_table


def test_heavy_rows_are_dealt(spark, tmp_path):
    rows = 3 * HEAVY_ROWS + 1
    one = spark.range(rows).select(F.col("id").alias("c_custkey"), F.lit("N").alias("c_name")).coalesce(1)
    one.write.parquet(f"{tmp_path}/customer.parquet")
    assert catalog._corpus(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    few = spark.range(10).coalesce(1)
    assert dealt(few) is few


def test_bound_lets_the_best_through():
    rng = np.random.default_rng(5)
    for n in (3, 700, 1000, 1037):
        order = rng.normal(size=(9, n))
        order[0, : n // 2] = np.inf
        for k in (1, 3):
            exact = np.partition(order, k - 1, axis=1)[:, k - 1]
            assert (_kth_bound(order, k) >= exact).all()


def test_pairs_of_a_search_get_their_own_tasks(spark):
    e = spark.range(60).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    found = top_k_similar(e.withColumnRenamed("id", "query_id"), e, 1, block_rows=10, query_rows_per_group=10)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert found.where("id <> query_id").count() == 0


def test_best_of_bags_is_an_arrow_function(spark):
    store = np.zeros((1, DEFAULT_DIM))
    store[0, 3] = 1.0
    bc = spark.sparkContext.broadcast((store, (store * store).sum(axis=1)))
    rows = spark.createDataFrame([(0, [[3, 3], [4]]), (1, []), (2, None), (3, [[], [3]])], "id long, bags array<array<int>>")
    df = rows.select("id", best_match_for_bags(F.col("bags"), bc, DEFAULT_DIM, "cosine").alias("s"))
    assert {r.id: r.s for r in df.collect()} == {0: [1.0, 0.0], 1: [], 2: None, 3: [0.0, 1.0]}
    assert "ArrowEvalPython" in df._jdf.queryExecution().toString() and "pandas" not in type(best_match_for_bags).__name__


def test_only_frequent_texts_are_salted(spark, monkeypatch):
    seen = []
    real = A.top_k_similar
    monkeypatch.setattr(A, "top_k_similar", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    monkeypatch.setattr(A, "FREQUENT", 5)
    docs = spark.createDataFrame([(i, f"mail a{i % 2 and i}@b.com now") for i in range(20)] + [(1, "mail z@b.com")], "doc_id long, text string")
    history = spark.createDataFrame([("h1", "a0 b com"), ("h2", "other")], "id string, text string")
    a = A.audit(docs, with_drift=False)
    lists = A.similar_lists(a, history)
    n = a.select(F.sum(F.size("violations"))).first()[0]
    assert lists.count() == n                      # one row per violation
    nested = A.attach_similar(a, history).select("doc_id", F.explode("violations").alias("v"))
    assert nested.where(F.size("v.similar_violations") >= 2).count() == nested.count() == n   # an id that repeats, too


def test_bucket_is_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vector_table, "TASK_RECORDS", 10)
    t = vector_table.VectorTable(spark, f"{checkpoint_dir(spark)}/round3-store-{uuid.uuid4().hex}", buckets=1)
    rows = spark.range(100).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.col("id").cast("string").alias("id"))
    bare = vector_table.records_of(rows, "id", "text", stored_at=F.timestamp_seconds(F.lit(0))).drop("embedding")
    t.upsert(bare.unionAll(bare))
    got = t.read()
    assert got.count() == 100 and got.where(F.size("embedding") == DEFAULT_DIM).count() == 100
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{t.path}/data")
    assert files.count() > 5


def test_large_bucket_loses_no_pair(spark, monkeypatch):
    """Sets whose values agree in pairs but not with the bucket's first set stay candidates."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "DEPTH", 0)
    base = np.arange(jaccard.T, dtype=np.uint32)
    rows = []
    for i in range(40):
        emb = base.copy()
        emb[40:] += np.uint32(1000 * (i + 1))   # 40 values shared by all
        rows.append((bytes([i]) * 16, emb.tobytes()))
    nodes = spark.createDataFrame(rows, "node binary, emb binary")
    edges = {(bytes(r.a), bytes(r.b)) for r in jaccard.candidate_edges(nodes, 0.95, 0.9995).collect()}
    linked = {x for e in edges for x in e}
    assert linked == {r[0] for r in rows}


@pytest.mark.parametrize("m", [1, 3, 6])
def test_paths_keep_a_pair(m):
    n = jaccard.paths_for(0.8, m, 0.9995)
    assert (1 - 0.8 ** m) ** n <= 0.0005


def test_ids_come_from_columns():
    top = pa.table({"lang": ["b", "a", "a"], "f": [9, 5, 7], "phrase": ["x", "y", "z"]})
    rows, ids = collocations.tile_ids(top)
    assert rows["phrase"].to_pylist() == ["z", "y", "x"] and ids.tolist() == [0, 1, collocations.TILE]


def test_uploads_are_written_by_many_tasks(spark, tmp_path):
    n = 2 * catalog.UPLOADS_PER_TASK + 1
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    _, rows = catalog._uploads(spark, str(tmp_path), "documents", catalog._upload_name(), F.lit(True))
    assert rows.rdd.getNumPartitions() == 3


def test_rows_of_one_upload_are_one_file(spark, tmp_path):
    """A document that repeats is one file with both texts, however many tasks write."""
    n = 2 * catalog.UPLOADS_PER_TASK
    spark.range(n).select((F.col("id") % (n // 2) * 10).alias("doc_id"), F.lit("t").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    back = catalog.s1_read_corpus(spark, str(tmp_path))
    assert back.count() == n // 2 and {r.n_chars for r in back.select("n_chars").distinct().collect()} == {3}
