"""Stored vector tables, streams with large templates and history, hooks and
embedders of the caller's."""

import glob
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.functions.embedders import Embedder
from clausewise.operators.drift import chunks, detect_drift, with_similarities
from clausewise.operators.rewrite import template_context
from clausewise.plans.audit import audit
from clausewise.session import checkpoint_dir
from clausewise.sources.vector_table import VectorTable, records_of, violation_records
from clausewise.streaming.audit_stream import audit_batches, document_stream


def fresh(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def records(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string, v array<double>, at int")
    return records_of(df, "id", "text", "v", stored_at=F.timestamp_seconds("at"))


def held(df):
    return {r.id: (r.text, list(r.embedding)) for r in df.collect()}


def test_table_replaces_by_id(spark):
    t = VectorTable(spark, fresh(spark, "table"), buckets=4)
    assert t.read().count() == 0 and t.commits() == []
    first = [(f"k{i}", f"one {i}", [float(i), 0.0], 5) for i in range(20)] + [("k3", "late", [9.0, 9.0], 7), ("k3", "early", [8.0, 8.0], 1)]
    second = [(f"k{i}", f"two {i}", [float(i), 1.0], 2) for i in range(10, 25)]
    assert t.upsert(records(spark, first)) == 0 and t.upsert(records(spark, second)) == 1
    want = {f"k{i}": (f"one {i}", [float(i), 0.0]) for i in range(10)} | {f"k{i}": (f"two {i}", [float(i), 1.0]) for i in range(10, 25)}
    want["k3"] = ("late", [9.0, 9.0])
    again = VectorTable(spark, t.path, buckets=4)  # reload
    assert held(again.read()) == want
    assert held(again.read(as_of=0)) == {k: v for k, v in held(again.read(as_of=0)).items() if v[0].startswith(("one", "late"))}
    t.upsert(records(spark, second), version=1)    # repeated
    t.upsert(records(spark, second[:3]), version=1)  # repeated with less: the version is what was written last
    assert len(held(t.read())) == 20 and t.next_version() == 2
    t.upsert(records(spark, second), version=1)
    assert t.compact() == 2 and held(t.read()) == want
    t.upsert(records(spark, [("k0", "three", [3.0, 3.0], 0), ("new", "n", [1.0, 1.0], 0)]))
    t.upsert(records(spark, second[:1]), version=0)  # compacted long ago: nothing changes
    want |= {"k0": ("three", [3.0, 3.0]), "new": ("n", [1.0, 1.0])}
    assert held(t.read()) == want and t.commits() == [(0, "delta"), (1, "delta"), (2, "base"), (3, "delta")]
    found = t.lookup(["k0", "k24", "none"])
    assert held(found) == {k: want[k] for k in ("k0", "k24")}
    plan = found._jdf.queryExecution().toString()
    assert all("bucket" in line.split("]")[0] for line in plan.split("PartitionFilters: [")[1:])  # other buckets are not read


def test_an_uncommitted_version_does_not_count(spark):
    t = VectorTable(spark, fresh(spark, "table"), buckets=2)
    t.upsert(records(spark, [("a", "x", [1.0], 1)]))
    records(spark, [("b", "y", [2.0], 1)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{t.path}/data/version=1")
    assert set(held(t.read())) == {"a"}


BERTHS = [f"clause number{i} of the harbour rules about berth{i % 7} and its ropes" for i in range(5000)]


@pytest.fixture(scope="module")
def harbour(spark):
    folder = fresh(spark, "harbour")
    texts = [(i, f"{BERTHS[i * 3]}, signed by nobody\n\n" + "other words entirely, with no clause " * 3 + f"\n\nmail a{i}@b.example") for i in range(40)]
    docs = spark.createDataFrame([*texts, (900, None), (901, "short")], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    templates = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(BERTHS)], "template_id string, text string")
    history = spark.createDataFrame([(f"h{i}", f"similarity of berth {i} deviates") for i in range(50)] + [("m", "a3@b.example")], "id string, text string")
    return folder, templates, history


def detail(audited):
    seen = F.transform("violations", lambda v: F.struct(v["type"], v["severity"], F.round(v["similarity"], 9).alias("s"),
                                                        F.transform(v["similar_violations"], lambda h: h["id"]).alias("h")))
    return audited.select("doc_id", "decision", "violation_score", F.to_json(seen).alias("seen"))


def test_stream_with_5000_templates_and_history_equals_batch(spark, harbour):
    folder, templates, history = harbour
    out, chk = fresh(spark, "out"), fresh(spark, "chk")

    def run():
        stream = document_stream(spark, f"{folder}/documents.parquet", max_files_per_trigger=2)
        q = audit_batches(stream, out, chk, templates, history, shape=detail, broadcast_bytes=1000)
        q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).drop("batch_id").collect()))

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(map(tuple, detail(audit(docs, templates=templates, history=history)).collect()))
    assert run() == want and len(want) == 42 and any('"h":["m"' in w[3] for w in want)
    batches = glob.glob(f"{chk}/commits/[0-9]*")
    assert len(batches) == 2
    last = max(batches)  # the last batch was not committed: it is replayed
    os.rename(last, f"{chk}/lost-commit")
    os.rename(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc", f"{chk}/lost-crc")
    assert run() == want


def test_large_templates_in_a_plain_stream_are_an_error(spark, harbour):
    folder, templates, _ = harbour
    with pytest.raises(ValueError, match="micro-batches"):
        audit(document_stream(spark, f"{folder}/documents.parquet"), templates=templates, broadcast_bytes=1000)


def test_violations_become_history(spark, harbour):
    folder, _, _ = harbour
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    audited = audit(docs)
    t = VectorTable(spark, fresh(spark, "history"), buckets=3)
    for _ in range(2):  # a run stored twice is stored once
        t.upsert(violation_records(audited, "run-1", stored_at=F.timestamp_seconds(F.lit(1))), version=0)
    n = audited.select(F.sum(F.size("violations"))).first()[0]
    past = t.read()
    assert past.count() == n
    found = audit(docs.where("doc_id = 3"), history=past.select("id", "text", "embedding")).select(F.explode("violations").alias("v"))
    own = {r.v.text or r.v.message: r.v.similar_violations for r in found.collect()}
    assert all(round(s[0].similarity, 9) == 1.0 and s[0].text == q for q, s in own.items())  # its own past violations


def word_lengths():
    """A model's loader: vectors of word lengths; it fails on texts that say so."""
    def load():
        def model(texts):
            if any("FAIL" in t for t in texts):
                raise RuntimeError("no")
            return [[float(sum(len(w) % 4 == k for w in t.split())) for k in range(4)] for t in texts]
        return model
    return load


def test_embedder_and_supplied_vectors(spark):
    embedder = Embedder(word_lengths(), 4, batch=3)
    templates = spark.createDataFrame([(f"t{i}", w) for i, w in enumerate(["a bb ccc dddd", "eeee ffff", "g hh iii", "FAIL"])], "template_id string, text string")
    docs = spark.createDataFrame([(i, f"{'word of the day ' * (4 + i)}\n\n{'FAIL ' * 20}\n\n{'sails and ropes ' * 9}") for i in range(7)] + [(9, None), (10, "x")],
                                 "doc_id long, text string")
    model = word_lengths()()
    vec = lambda t: np.array(model([t])[0]) if "FAIL" not in t else np.zeros(4)
    store = [vec(t) for t in ["a bb ccc dddd", "eeee ffff", "g hh iii", "FAIL"]]
    want = {}
    for r in docs.collect():
        kept = [p.strip() for p in (r.text or "").split("\n\n") if len(p.strip()) > 50]
        want[r.doc_id] = [round(max(1 / (1 + ((vec(c) - s) ** 2).sum()) for s in store), 9) for c in kept]
    cut = docs.select("doc_id", chunks(F.col("text")).alias("c"))
    for limit in (10**9, 0):  # broadcast, and the blocked search
        got, _ = with_similarities(cut, templates, "c", embedder=embedder, broadcast_bytes=limit)
        assert {r.doc_id: [round(x, 9) for x in r["_sims"]] for r in got.collect()} == want
        given = spark.createDataFrame([(i, [list(map(float, vec(c))) for c in [p.strip() for p in (t or "").split("\n\n") if len(p.strip()) > 50]])
                                       for i, t in [(r.doc_id, r.text) for r in docs.collect()]], "doc_id long, vectors array<array<double>>")
        supplied = spark.createDataFrame([(f"t{i}", list(map(float, s))) for i, s in enumerate(store)], "template_id string, embedding array<double>")
        got, _ = with_similarities(cut.join(given, "doc_id"), supplied, "c", vectors_col="vectors", broadcast_bytes=limit)
        assert {r.doc_id: [round(x, 9) for x in r["_sims"]] for r in got.collect()} == want
    rows = detect_drift(docs, templates, embedder=embedder).collect()
    assert len(rows) == sum(s < 0.7 for v in want.values() for s in v)
    history = spark.createDataFrame([("h1", "word of the day"), ("h2", "eeee")], "id string, text string")
    audited = audit(docs, templates=templates, history=history, embedder=embedder)
    assert audited.count() == 9 and template_context(audited, templates, embedder=embedder).count() > 0
    drift = {r.doc_id: r.drift_found for r in audited.select("doc_id", "drift_found").collect()}
    assert drift == {i: sum(s < 0.7 for s in v) for i, v in want.items()}


def test_hooks_reach_the_audit(spark):
    docs = spark.createDataFrame([(1, "x" * 1200 + " contract; account 12345678901")], "doc_id long, text string")
    plain, whole = audit(docs).first(), audit(docs, prefix_chars=None).first()
    assert (plain.document_type, whole.document_type) == ("unknown", "contract")
    kind = lambda t: F.struct(F.lit("invoice").alias("document_type"), F.lit(0.3).alias("confidence"))
    got = audit(docs, classify_fn=kind).first()
    assert (got.document_type, got.classification_confidence) == ("invoice", 0.3)
    never = lambda span, ctx, pii: F.struct(F.lit(False).alias("confirmed"), F.lit(0.0).alias("confidence"))
    kinds = lambda r: {v.pii_type for v in r.violations if v.type == "pii"}
    assert "account_number" in kinds(plain) and "account_number" not in kinds(audit(docs, confirm_pii=True, confirm_fn=never).first())
