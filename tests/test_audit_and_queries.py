import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from clausewise.operators.evaluate import evaluate_pii
from clausewise.operators.pii import scan_pii
from clausewise.plans.audit import audit, final_text
from clausewise.sources.corpus import generate_corpus
from clausewise.session import load_table

SF = "/root/testdata/sf0.001"


def test_end_to_end_contract(spark):
    doc = spark.createDataFrame([(1, "Lease contract of the boathouse. Either side can terminate it in spring.")],
                                "doc_id long, text string")
    r = audit(doc).first()
    assert r.document_type == "contract" and r.decision in {"Auto-Approve", "Auto-Fix", "Require Review", "Reject"}
    assert [v.seq for v in r.violations] == list(range(len(r.violations)))
    assert len(r.suggestions) == len(r.violations)


def test_unreadable_documents_are_error_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "plain words")], "doc_id long, text string")
    rows = {r.doc_id: r for r in audit(docs).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert all(rows[i].status == "error" and rows[i].decision is None and rows[i].error for i in (1, 2, 3))
    assert rows[4].status == "ok" and rows[4].decision == "Auto-Approve"


def test_masked_write_holds_no_clear_value(spark):
    import uuid
    from clausewise.session import checkpoint_dir
    from clausewise.sources.ingest import write_audit
    docs = spark.createDataFrame([(1, "write to olaf.berg@fjord.example today"), (2, "policy for olaf.berg@fjord.example and all")],
                                 "doc_id long, text string")
    paths = write_audit(audit(docs, with_drift=False), f"{checkpoint_dir(spark)}/masked-{uuid.uuid4().hex}", "r1", mask_pii_text=True)
    for path in paths.values():
        rows = spark.read.parquet(path)
        cols = [F.to_json(F.struct("*"))]
        assert rows.select(*cols).filter(F.col(rows.select(*cols).columns[0]).contains("olaf.berg")).count() == 0, path


def test_segments_rebuild_final_text(spark):
    from clausewise.operators.rewrite import apply_fixes, change_segments
    c = generate_corpus(load_table(spark, SF, "customer"))
    a = audit(c.select("doc_id", "text")).cache()
    segs = {}
    for r in change_segments(a).orderBy("doc_id", "seg").collect():
        segs.setdefault(r.doc_id, []).append((r.op, r.text))
    rows = a.select("doc_id", "text", apply_fixes(F.col("text"), F.col("suggestions")).alias("final")).collect()
    for r in rows:
        got = segs[r.doc_id]
        assert "".join(t for op, t in got if op != "delete") == r.final
        assert "".join(t for op, t in got if op != "insert") == r.text


def test_checkpoint_needs_a_shared_folder_off_local_mode():
    from clausewise.session import local_scratch
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            local_scratch(master)


def test_corpus_golden_values(spark):
    c = generate_corpus(load_table(spark, SF, "customer"))
    a = audit(c.select("doc_id", "text"), with_drift=False).join(
        c.select("doc_id", F.col("document_type").alias("label_type"), "variant"), "doc_id")
    rows = a.collect()
    assert all(r.document_type == r.label_type for r in rows)
    for r in rows:
        if r.label_type == "contract":
            exp = 8 if r.variant < 5 else (5 if r.variant >= 8 else 0)
            assert r.violation_score == exp, (r.variant, r.violation_score)
        if r.label_type == "policy":
            assert r.signature_violations == 1
    det = scan_pii(c.select("doc_id", "text")).groupBy("doc_id").agg(F.collect_list("text").alias("det"))
    lab = c.select("doc_id", F.transform(F.coalesce("label.pii_spans", F.array().cast(
        "array<struct<span_start:int,span_end:int,pii_type:string,text:string>>")), lambda s: s["text"]).alias("gt"))
    m = evaluate_pii(det, lab).first()
    assert m.precision == 1.0 and m.recall == 1.0


def test_final_text_applies_fixes(spark):
    doc = spark.createDataFrame([(1, "Call 555-123-4567 today")], "doc_id long, text string")
    a = audit(doc, with_drift=False)
    r = a.first()
    assert r.decision == "Auto-Fix"
    assert final_text(a).first().final_text == "Call [REDACTED] today"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "decision" in df.columns


@pytest.mark.parametrize("name", ["t1_classify", "p1_pii_spans", "r7_policy_violations", "s13_generate_corpus",
                                  "o2_duration_histogram", "s7_assemble_documents", "s8_heading_tagging",
                                  "f2_change_segments", "q4_stream_metrics", "q1_audit_requested", "s6_ocr_blocks",
                                  "t1_classify_whole", "s4_route_file_type"])
def test_registered_queries_match_oracle(spark, name):
    import duckdb
    from clausewise.session import DRIVER_TABLES
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    s = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    d = sorted((tuple(norm(r[dcols.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert s == d


def test_similar_violations_do_not_depend_on_salts(spark, monkeypatch):
    import clausewise.plans.audit as A
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["mail a@b.com now", "mail a@b.com now", "call 555-123-4567", "policy text without version",
         "HR employee form", "HR employee form too", "nothing"])], "doc_id long, text string")
    hist = spark.createDataFrame([("1", "email address"), ("2", "missing manager approval"), ("3", "phone")],
                                 "id string, text string")
    a = audit(docs, with_drift=False)

    def rows():
        return sorted((r.doc_id, r.seq, r.rank, r.history_id) for r in A.similar_violations_long(a, hist).collect())
    many = rows()
    monkeypatch.setattr(A, "SALTS", 1)
    assert rows() == many and len(many) > 0


def test_large_rule_and_policy_tables(spark):
    """5,000 rules and 20,000 policies by join: only the matching ones show."""
    from clausewise.operators.rules import RULE_TYPE, rules_table
    more = [(f"X_{i}", f"X_{i}", "extra", "low", f"missing word {i}", [f"word{i}"], ["memo" if i else "all"]) for i in range(5000)]
    rules = rules_table(spark).unionByName(spark.createDataFrame(more, RULE_TYPE))
    policies = spark.createDataFrame([(f"X_{i}", f"text {i}") for i in range(20_000)] + [("X_0", "zz later"), ("HR_001", "hr text")],
                                     "policy_id string, content string")
    docs = spark.createDataFrame([(1, "employee request"), (2, "plain"), (3, "word0 and signature of an employee")], "doc_id long, text string")
    got = {r.doc_id: [(v.rule_id, v.policy_snippet) for v in r.violations if v.type == "policy_violation"]
           for r in audit(docs, rules=rules, policies=policies, with_drift=False).collect()}
    assert got == {1: [("HR_001", "hr text"), ("X_0", "zz later")], 2: [("X_0", "zz later")], 3: []}


def test_built_in_rules_by_join_and_by_literal(spark):
    from clausewise.operators.rules import rules_table
    docs = generate_corpus(load_table(spark, SF, "customer")).select("doc_id", "text")
    plain = audit(docs).select("doc_id", "violations", "rules_checked").collect()
    joined = audit(docs, rules=rules_table(spark)).select("doc_id", "violations", "rules_checked").collect()
    assert sorted(plain, key=lambda r: r.doc_id) == sorted(joined, key=lambda r: r.doc_id)


def test_audit_stream_equals_batch(spark):
    from clausewise.streaming.audit_stream import run_audit_stream
    stream = {(r.doc_id, r.decision, r.violation_score, r.n_violations)
              for r in run_audit_stream(spark, SF).collect()}
    batch_df = audit(load_table(spark, SF, "documents").select("doc_id", "text"))
    batch = {(r.doc_id, r.decision, r.violation_score, len(r.violations)) for r in batch_df.collect()}
    assert stream == batch and len(batch) == load_table(spark, SF, "documents").count()


def test_severity_stream_totals(spark):
    from clausewise.streaming.metrics_stream import severity_counts_stream_run
    got = {r.severity: r.violations for r in severity_counts_stream_run(spark, SF).collect()}
    a = audit(load_table(spark, SF, "documents").select("doc_id", "text"))
    exp = {}
    for r in a.select(F.explode("violations").alias("v")).collect():
        exp[r.v.severity] = exp.get(r.v.severity, 0) + 1
    assert got == exp


def test_audit_status_pushdown_and_not_found(spark):
    import os
    import uuid
    from clausewise.session import checkpoint_dir
    from clausewise.sources.ingest import audit_status, write_audit
    docs = spark.createDataFrame([(1, "mail a@b.com"), (2, "clean text")], "doc_id long, text string")
    out = os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")
    paths = write_audit(audit(docs, with_drift=False), out, "r1")
    df = audit_status(spark, paths["audit_results"], [1, 99])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(doc_id" in plan
    got = {r.doc_id: r.status for r in df.collect()}
    assert got == {1: "completed", 99: "not_found"}
