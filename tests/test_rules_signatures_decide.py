from pyspark.sql import functions as F

from clausewise.operators.decide import decide, score
from clausewise.operators.rules import apply_policy_rules
from clausewise.operators.signatures import find_signatures, missing_signatures
from clausewise.operators.triage import classify_documents
from clausewise.functions.violations import violation


def test_triage_order_and_substrings(spark):
    df = spark.createDataFrame([(1, "This AGREEMENT and policy"), (2, "through the woods"),
                                (3, "meeting notes"), (4, None), (5, "x" * 1000 + " contract")],
                               "doc_id long, text string")
    got = {r.doc_id: (r.document_type, r.classification_confidence) for r in classify_documents(df).collect()}
    assert got[1] == ("contract", 0.9)
    assert got[2][0] == "hr_form"          # "through" contains "hr"
    assert got[3] == ("unknown", 0.5)
    assert got[4] == ("unknown", 0.5)
    assert got[5][0] == "unknown"          # keyword beyond the first 1000 chars


def test_policy_rules_table_driven(spark):
    df = spark.createDataFrame([
        (1, "contract", "no clause here"), (2, "contract", "may TERMINATE"),
        (3, "policy", "nothing"), (4, "policy", "Version 2, dated today"),
        (5, "invoice", "meeting"),  # 'meeting' contains 'tin'
        (6, "hr_form", "approved by boss"), (7, "unknown", "anything")],
        "doc_id long, document_type string, text string")
    rows = apply_policy_rules(df).collect()
    got = sorted((r.doc_id, r.rule_id, r.check_id) for r in rows)
    assert got == [(1, "CONTRACT_001", "CONTRACT_001"), (3, "POLICY_001", "POLICY_001"),
                   (3, "POLICY_001", "POLICY_002")]
    r1 = [r for r in rows if r.doc_id == 1][0]
    assert (r1.span_start, r1.span_end, r1.severity) == (0, len("no clause here"), "high")


def test_signatures(spark):
    df = spark.createDataFrame([(1, "contract", "Authorized signature: x"), (2, "policy", "none"),
                                (3, "invoice", "none"), (4, "hr_form", "signature image.png"),
                                (5, "contract", "ſigned   by me")],
                               "doc_id long, document_type string, text string")
    hits = find_signatures(df).collect()
    assert len([h for h in hits if h.doc_id == 1]) == 2          # counted per pattern
    assert any(h.type == "signature_image" and h.confidence == 0.7 for h in hits if h.doc_id == 4)
    assert any(h.doc_id == 5 for h in hits)                      # Unicode case folding
    miss = {r.doc_id: r.message for r in missing_signatures(df).collect()}
    assert miss == {2: "policy document missing required signature/approval"}


def test_score_and_decision(spark):
    def v(sev):
        return violation(type="x", severity=sev)
    df = spark.range(1).select(
        F.array(v("critical"), v("high"), v("medium"), v("low"), v(None), v("weird")).alias("a"),
        F.array(v("medium")).alias("b"), F.array(v("high")).alias("c"),
        F.array().cast("array<struct<seq:int,severity:string>>").alias("e"))
    r = df.select(score(F.col("a")).alias("s"), score(F.col("b")).alias("sb"), score(F.col("c")).alias("sc")).first()
    assert r.s.violation_score == 10 + 5 + 2 + 1 + 1 + 1
    assert (r.s.critical, r.s.high, r.s.medium, r.s.low) == (1, 1, 1, 3)
    d = spark.range(1).select(decide(F.lit(0), F.lit(0)).alias("a"), decide(F.lit(2), F.lit(1)).alias("b"),
                              decide(F.lit(2), F.lit(0)).alias("c"), decide(F.lit(5), F.lit(1)).alias("d"),
                              decide(F.lit(6), F.lit(1)).alias("e")).first()
    assert [d.a.decision, d.b.decision, d.c.decision, d.d.decision, d.e.decision] == [
        "Auto-Approve", "Auto-Fix", "Require Review", "Require Review", "Reject"]
    assert d.d.reason == "Medium severity violations (5 points) require human review"
