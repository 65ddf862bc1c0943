"""PII spans against Python `re` (the semantics being reproduced)."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from clausewise.functions.text import finditer
from clausewise.operators.pii import PII_PATTERNS, pii_violations, redact, scan_pii


def _df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_one_case_per_type(spark):
    rows = scan_pii(_df(spark, ["Parcels go to depot@harbour.example before noon.",
                                "The night desk answers 555-208-9913 only.", "insured under 219-09-9999"])).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert any(r.pii_type == "email" and "depot@harbour.example" in r.text for r in by[0])
    assert any(r.pii_type == "phone" for r in by[1])
    ssn = [r for r in by[2] if r.pii_type == "ssn"]
    assert ssn and ssn[0].severity == "high" and ssn[0].confidence == 0.95


EDGE = ["", None, "no matches here", "a@b.co at start", "ends with 555-123-4567",
        "4111111111111111", "١٢٣-٤٥-٦٧٨٩ arabic digits", "x123-45-6789", "é123-45-6789",
        "123-45-6789é", "john@example.com555-123-4567", "   ", "DE89370400440532013000 iban",
        "12345678 and 123456789012 and 1234567890123"]


def test_spans_equal_python(spark):
    random.seed(3)
    pieces = ["john.doe@example.com", "555-123-4567", "123-45-6789", "4111 1111 1111 1111",
              "DE89370400440532013000", "12345678901", "é", "٣", "½", " ", " ", "x", "_", "\n", "-"]
    texts = EDGE + ["".join(random.choice(pieces) for _ in range(random.randint(0, 8))) for _ in range(300)]
    df = _df(spark, texts)
    cols = [finditer(F.col("text"), p).alias(n) for n, p in PII_PATTERNS]
    for r in df.select("doc_id", "text", *cols).collect():
        t = r.text or ""
        for n, p in PII_PATTERNS:
            exp = [(m.start(), m.end(), m.group()) for m in re.finditer(p, t)]
            got = [(s.span_start, s.span_end, s.text) for s in r[n]]
            assert got == exp, (n, t)


def _py_redact(text, spans):
    out = text
    for s in sorted(spans, key=lambda x: x[0], reverse=True):
        h = hashlib.sha256(text[s[0]:s[1]].encode()).hexdigest()[:8]
        out = out[:s[0]] + f"[REDACTED_{h}]" + out[s[1]:]
    return out


def test_redaction_equals_python(spark):
    texts = [t for t in EDGE if t is not None] + ["mail a@b.com and c@d.org", "4111 1111 1111 1111 card"]
    df = _df(spark, texts).select("doc_id", "text", pii_violations(F.col("text")).alias("v"))
    for r in df.select("text", "v", redact(F.col("text"), F.col("v")).alias("red")).collect():
        spans = [(v.span_start, v.span_end) for v in r.v]
        assert r.red == _py_redact(r.text, spans)


def test_overlapping_spans_follow_sequential_rule(spark):
    # a 16-digit card is also a phone match: overlapping spans are all kept
    df = _df(spark, ["card 4111111111111111 end"])
    r = df.select(pii_violations(F.col("text")).alias("v")).first()
    kinds = sorted(v.pii_type for v in r.v)
    assert "credit_card" in kinds and "phone" in kinds
    red = df.select(redact(F.col("text"), pii_violations(F.col("text"))).alias("x")).first().x
    spans = [(v.span_start, v.span_end) for v in r.v]
    assert red == _py_redact("card 4111111111111111 end", spans)


def test_redact_no_spans_is_identity(spark):
    df = _df(spark, ["nothing to hide"])
    assert df.select(redact(F.col("text"), pii_violations(F.col("text"))).alias("x")).first().x == "nothing to hide"


def test_confirmation_drops_unconfirmed(spark):
    from clausewise.operators.pii import scan_pii as sp

    def reject_all(span, ctx, kind):
        return F.struct(F.lit(False).alias("confirmed"), F.lit(0.1).alias("confidence"))
    df = _df(spark, ["acct 12345678901 and mail a@b.com"])
    kinds = {r.pii_type for r in sp(df, confirm=True, confirm_fn=reject_all).collect()}
    assert "account_number" not in kinds and "email" in kinds
    conf = {r.pii_type: r.confidence for r in sp(df, confirm=True).collect()}
    assert conf["account_number"] == 0.9 and conf["email"] == 0.95
