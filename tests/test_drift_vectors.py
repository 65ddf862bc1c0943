import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.operators.drift import chunk_table, detect_drift
from clausewise.operators.vectors import approx_candidate_share, approx_top_k_similar, top_k_similar, upsert_vectors


def test_near_and_far_texts(spark):
    tpl = spark.createDataFrame([("t", "Boats are moored at the north pier and paid for by the week.")],
                                "template_id string, text string")
    same = spark.createDataFrame([(1, "Boats are moored at the north pier and paid for by the week. Bring ropes.")],
                                 "doc_id long, text string")
    rows = detect_drift(same, tpl).collect()
    assert all(r.similarity > 0.7 for r in rows)  # no drift row, or only above threshold
    tpl2 = spark.createDataFrame([("c", "RENTAL TERMS\n\nDEPOSIT: The deposit is returned in autumn.")],
                                 "template_id string, text string")
    other = spark.createDataFrame([(2, "Seven lanterns hung over a courtyard where nobody had rented anything in years.")],
                                  "doc_id long, text string")
    assert len(detect_drift(other, tpl2).collect()) > 0


def test_empty_store_flags_low(spark):
    tpl = spark.createDataFrame([], "template_id string, text string")
    doc = spark.createDataFrame([(1, "x" * 60)], "doc_id long, text string")
    r = detect_drift(doc, tpl).collect()
    assert len(r) == 1 and r[0].severity == "low" and r[0].message == "No matching template found"


def test_chunks_boundaries(spark):
    p50, p51 = "a" * 50, "b" * 51
    doc = spark.createDataFrame([(1, f"{p50}\n\n  {p51}  \n\n\n\n{p51}")], "doc_id long, text string")
    rows = chunk_table(doc).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chunk_chars) for r in rows] == [(0, 51), (1, 51)]
    assert rows[0].span_start == rows[1].span_start == 54   # first occurrence of the chunk


def _brute(q, s, k, metric):
    out = {}
    for qi, qv in q:
        sims = []
        for si, sv in s:
            if qi == si:
                continue
            if metric == "l2":
                d = float(((np.array(qv) - np.array(sv)) ** 2).sum())
                sims.append((-(1 / (1 + d)), si))
            else:
                a, b = np.array(qv), np.array(sv)
                sims.append((-(float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b))), si))
        out[qi] = [si for _, si in sorted(sims)[:k]]
    return out


def test_topk_equals_brute_force_for_any_block_size(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(vecs, "id long, embedding array<double>")
    for metric in ("l2", "cosine"):
        exp = _brute(vecs, vecs, 3, metric)
        # one block; several blocks with one query group; several groups
        for block_rows, qrows in ((4096, 200_000), (7, 200_000), (7, 13)):
            got = {}
            for r in top_k_similar(df.withColumnRenamed("id", "query_id"), df, 3, metric=metric,
                                   exclude_self=True, block_rows=block_rows,
                                   query_rows_per_group=qrows).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            assert got == exp, (metric, block_rows, qrows)


def test_approximate_recall_and_share(spark):
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(600, 32))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for vecs in (unit, rng.normal(size=(40, 8))[np.arange(400) % 40] + 0.01 * rng.normal(size=(400, 8))):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "id long, embedding array<double>")
        q = df.withColumnRenamed("id", "query_id")
        for metric in ("l2", "cosine"):
            exact = {(r.query_id, r.id) for r in top_k_similar(q, df, 3, metric, exclude_self=True).collect()}
            rows = approx_top_k_similar(q, df, 3, metric=metric, exclude_self=True).collect()
            small = approx_top_k_similar(q, df, 3, metric=metric, exclude_self=True, block_rows=3, query_rows_per_group=2).collect()
            assert sorted((r.query_id, r.rank, r.id) for r in rows) == sorted((r.query_id, r.rank, r.id) for r in small)
            assert len({(r.query_id, r.id) for r in rows} & exact) >= 0.9 * len(exact)
        share = approx_candidate_share(q, df).first()
        # tables x probes / cells of all pairs where cells are even; groups of near copies make them uneven
        assert share.pairs == len(vecs) ** 2 and 0 < share.share < (0.25 if vecs is unit else 0.5)
    empty = df.limit(0)
    assert approx_top_k_similar(q, empty, 3).count() == 0 and approx_candidate_share(q, empty).first().scored == 0
    one = df.limit(1)
    assert [r.id for r in approx_top_k_similar(q.limit(2), one, 3).collect()] == [0, 0]


def test_ties_and_ids_of_any_type(spark):
    df = spark.createDataFrame([(f"v{i:02}", [float(i % 3), 1.0, 0.0]) for i in range(30)] + [("zero", [0.0, 0.0, 0.0])], "id string, embedding array<float>")
    for metric in ("l2", "cosine"):
        got = top_k_similar(df.withColumnRenamed("id", "q"), df, 4, metric, query_id="q", exclude_self=True, block_rows=11, query_rows_per_group=7)
        rows = {}
        for r in got.orderBy("q", "rank").collect():
            rows.setdefault(r.q, []).append(r.id)
        assert rows["v01"] == ["v04", "v07", "v10", "v13"] and rows["v04"] == ["v01", "v07", "v10", "v13"]
        assert len(rows["zero"]) == 4


def test_vectors_of_two_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="components in one column"):
        top_k_similar(df.withColumnRenamed("id", "query_id"), df, 1).collect()


def test_upsert_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 2, 2.0), ("a", 2, 2.0)],
                               "id string, stored_at int, v double")
    got = {r.id: r.v for r in upsert_vectors(df, "id", ("stored_at",)).collect()}
    assert got == {"a": 3.0, "b": 2.0}


def test_bag_queries_same_for_any_block_size(spark):
    from clausewise.functions.vectors import buckets
    from clausewise.plans.audit import history_vectors
    hist = spark.createDataFrame([(str(i), t) for i, t in enumerate(
        ["contract missing termination clause", "email address found", "policy version missing",
         "the quick brown fox", "signature required on the form", "phone number 555", "", "tax id absent"])],
        "id string, text string")
    hv = history_vectors(hist)
    qs = spark.createDataFrame([("Contract missing termination clause",), ("missing signature",), ("zzz",), ("",)],
                               "q string").withColumn("bag", buckets(F.col("q")))

    def run(block_rows):
        return sorted((r.q, r.rank, r.id, round(r.similarity, 9)) for r in top_k_similar(
            qs, hv, 3, query_id="q", query_vec="bag", query_kind="bag", store_id="id", store_vec="embedding",
            block_rows=block_rows).collect())
    assert run(4096) == run(3)


def test_excluded_self_need_not_be_in_the_store(spark):
    store = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id long, embedding array<double>")
    query = spark.createDataFrame([(77, [0.5, 1.0])], "query_id long, embedding array<double>")
    for rows in (None, 2):
        assert top_k_similar(query, store, 3, exclude_self=True, block_rows=rows).count() == 3


def test_drift_same_beyond_the_broadcast_bound(spark):
    """5,000 templates through the blocked kernel and through the broadcast."""
    from clausewise.operators.drift import chunks, with_similarities
    tpl = spark.createDataFrame([(f"t{i}", f"clause number{i} of the harbour rules about berth{i % 7}") for i in range(5000)],
                                "template_id string, text string")
    docs = spark.createDataFrame([(i, f"clause number{i} of the harbour rules about berth{i % 7} and ropes\n\n" + "other words entirely " * 4)
                                  for i in range(0, 60, 7)] + [(1000, None), (1001, "short")], "doc_id long, text string")
    docs = docs.select("doc_id", chunks(F.col("text")).alias("c"))

    def sims(limit):
        got, has = with_similarities(docs, tpl, "c", broadcast_bytes=limit)
        assert has
        return {r.doc_id: [round(x, 9) for x in r["_sims"]] for r in got.collect()}
    assert sims(10 ** 9) == sims(0)
