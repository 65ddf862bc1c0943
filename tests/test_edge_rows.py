"""Edge rows listed in FIXTURES.md, each checked against the sequential
Python rule it re-implements."""

from datetime import datetime

from pyspark.sql import functions as F

from clausewise.functions.text import apply_edits
from clausewise.functions.violations import violation
from clausewise.operators.decide import decide, score
from clausewise.operators.drift import chunk_table, detect_drift, template_vectors
from clausewise.operators.pii import scan_pii


def _py_edits(text, edits):
    out = text
    for s, e, r, _ in sorted(edits, key=lambda x: x[0], reverse=True):
        out = out[:s] + r + out[e:]
    return out


def test_edit_fold_out_of_range_and_overlaps(spark):
    text = "abcdefghij"
    cases = [[(2, 4, "X", 0), (3, 8, "YY", 1)],          # overlapping
             [(8, 30, "Z", 0), (0, 0, "<", 1)],            # end out of range, insert at 0
             [(5, 5, "a", 0), (5, 5, "b", 1), (5, 6, "c", 2)],  # equal starts keep input order
             [(40, 50, "far", 0)]]                          # wholly out of range
    df = spark.createDataFrame([(i, text, c) for i, c in enumerate(cases)],
                               "id int, t string, e array<struct<span_start:int,span_end:int,replacement:string,ord:int>>")
    for r in df.select("id", apply_edits(F.col("t"), F.col("e")).alias("o")).collect():
        assert r.o == _py_edits(text, cases[r.id]), cases[r.id]


def test_match_positions_and_adjacency(spark):
    df = spark.createDataFrame([(1, "a@b.coc@d.org"), (2, "x@y.com"), (3, "ends 123-45-6789"),
                                (4, "123-45-6789123-45-6789")], "doc_id long, text string")
    rows = scan_pii(df).collect()
    starts = {(r.doc_id, r.pii_type): r.span_start for r in rows}
    assert starts[(2, "email")] == 0 and starts[(3, "ssn")] == 5
    assert not any(r.doc_id == 4 and r.pii_type == "ssn" for r in rows)   # no word boundary between them


def test_same_paragraph_twice_and_whitespace_paragraphs(spark):
    p = "p" * 60
    df = spark.createDataFrame([(1, f"{p}\n\n   \n\n{p}")], "doc_id long, text string")
    rows = chunk_table(df).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == [0, 1]
    assert rows[0].span_start == rows[1].span_start == 0      # first occurrence, as text.find does


def test_severity_edge_cases(spark):
    df = spark.range(1).select(
        F.array(violation(severity="critical")).alias("crit"),
        F.array(violation(severity=None), violation(severity="unknown")).alias("odd"))
    r = df.select(score(F.col("crit")).alias("a"), score(F.col("odd")).alias("b")).first()
    assert (r.a.violation_score, r.a.critical) == (10, 1)
    assert (r.b.violation_score, r.b.low) == (2, 2)
    d = spark.range(1).select(decide(F.lit(10), F.lit(1)).alias("x")).first().x
    assert d.decision == "Reject"


def test_duplicate_template_ids_last_write_wins(spark):
    old, new = datetime(2024, 1, 1), datetime(2024, 2, 1)
    t = spark.createDataFrame([("t", "alpha beta gamma", old), ("t", "delta epsilon zeta", new)],
                              "template_id string, text string, stored_at timestamp")
    assert template_vectors(t).count() == 1
    doc = spark.createDataFrame([(1, "delta epsilon zeta " * 5), (2, "alpha beta gamma " * 5)],
                                "doc_id long, text string")
    flagged = {r.doc_id for r in detect_drift(doc, t).collect()}
    assert flagged == {2}          # only the text unlike the latest version drifts
