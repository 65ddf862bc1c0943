"""PII spans, scoring, optional confirmation, redaction.

All per-document work is one projection: each pattern's matches come from
`finditer` (JVM regex, Python-compatible classes), the six arrays are
concatenated in pattern order, and redaction is an array fold.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.text import apply_edits, cut, explode_rows, finditer, let, short_sha256, slice_cut, slice_text
from clausewise.functions.violations import violation

# Fixed values (must equal the reference's detector), in scan order.
PII_PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b"),
    ("account_number", r"\b\d{8,12}\b"),
]
# Cheap necessary conditions (our own, Java syntax): every match of the
# pattern contains a match of its prefilter, so skipping texts without one
# changes no result.
PREFILTERS = {
    "email": "@",
    "phone": r"\p{Nd}{3}",
    "ssn": r"\p{Nd}{3}-\p{Nd}{2}-",
    "credit_card": r"\p{Nd}{4}",
    "iban": r"[A-Z]{2}\p{Nd}{2}",
    "account_number": r"\p{Nd}{8}",
}
HIGH_SEVERITY_TYPES = ["ssn", "credit_card"]
REGEX_CONFIDENCE = 0.95
CONFIRM_TYPES = ["account_number", "iban"]
CONFIRM_CONTEXT_CHARS = 100
STUB_CONFIRM_CONFIDENCE = 0.9
REDACTION_HASH_CHARS = 8

# confirm(span_text, context, pii_type) -> struct<confirmed:boolean, confidence:double>
ConfirmFn = Callable[[Column, Column, Column], Column]


def stub_confirm(span_text: Column, context: Column, pii_type: Column) -> Column:
    """Default confirmation: accept every candidate at 0.9."""
    return F.struct(F.lit(True).alias("confirmed"), F.lit(STUB_CONFIRM_CONFIDENCE).alias("confidence"))


def pii_context(text: Column, start: Column, end: Column) -> Column:
    """`text[max(0, start-100) : min(len, end+100)]`."""
    lo = F.greatest(start - CONFIRM_CONTEXT_CHARS, F.lit(0))
    hi = F.least(end + CONFIRM_CONTEXT_CHARS, F.length(text))
    return slice_text(text, lo, hi)


@lru_cache(maxsize=32)
def _cached_pii(text_col: str, confirm: bool, app_id: str) -> Column:
    return pii_violations(F.col(text_col), confirm)


def pii_violations_of(df: DataFrame, text_col: str, confirm: bool = False,
                      confirm_fn: ConfirmFn | None = None) -> Column:
    """`pii_violations` for a named column; the (large) expression tree is
    built once per column and application and reused."""
    if confirm_fn is not None:
        return pii_violations(F.col(text_col), confirm, confirm_fn)
    return _cached_pii(text_col, confirm, df.sparkSession.sparkContext.applicationId)


def pii_violations(text: Column, confirm: bool = False,
                   confirm_fn: ConfirmFn | None = None) -> Column:
    """array<violation> of PII hits in pattern order, then match order."""
    confirm_fn = confirm_fn or stub_confirm
    per_type = []
    for pii_type, pattern in PII_PATTERNS:
        spans = finditer(text, pattern, prefilter=PREFILTERS.get(pii_type))
        if confirm and pii_type in CONFIRM_TYPES:
            per_type.append(_confirmed(text, spans, pii_type, confirm_fn))
        else:
            per_type.append(F.transform(spans, _to_violation(pii_type, None)))
    return F.concat(*per_type)


def _to_violation(pii_type: str, confidence: Column | None):
    severity = "high" if pii_type in HIGH_SEVERITY_TYPES else "medium"

    def build(s: Column) -> Column:
        return violation(scanner="pii", type="pii", pii_type=pii_type, span_start=s["span_start"],
                         span_end=s["span_end"], text=s["text"],
                         confidence=REGEX_CONFIDENCE if confidence is None else s["confidence"],
                         severity=severity)
    return build


def _confirmed(text: Column, spans: Column, pii_type: str, confirm_fn: ConfirmFn) -> Column:
    """Ask `confirm_fn` about each candidate with +-100 chars of context."""
    src = F.coalesce(text, F.lit(""))

    def ask(s: Column) -> Column:
        c = confirm_fn(s["text"], pii_context(src, s["span_start"], s["span_end"]), F.lit(pii_type))
        return s.withField("confirmed", c["confirmed"]).withField("confidence", c["confidence"])

    kept = F.filter(F.transform(spans, ask), lambda s: F.coalesce(s["confirmed"], F.lit(False)))
    return F.transform(kept, _to_violation(pii_type, F.lit(True)))


def redaction_edits(text: Column, spans: Column, order: str | None = None) -> Column:
    """Edits replacing each span by `[REDACTED_<sha256(original slice)[:8]>]`;
    equal starts follow the spans' order, or their field `order`."""
    return let(cut(F.coalesce(text, F.lit(""))), lambda pieces: F.transform(spans, lambda s, i: F.struct(
        s["span_start"].alias("span_start"),
        s["span_end"].alias("span_end"),
        F.concat(F.lit("[REDACTED_"),
                 short_sha256(slice_cut(pieces, s["span_start"], s["span_end"]), REDACTION_HASH_CHARS),
                 F.lit("]")).alias("replacement"),
        (s[order] if order else i).alias("ord"),
    )))


def redact(text: Column, spans: Column, order: str | None = None) -> Column:
    """Redact spans right to left (stable on equal starts)."""
    return apply_edits(text, redaction_edits(text, spans, order))


# ---------------------------------------------------------------- DataFrame ops

def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             confirm: bool = False, confirm_fn: ConfirmFn | None = None) -> DataFrame:
    """P1+P2(+P3): one row per detected span, `seq` = position in scan order."""
    v = pii_violations_of(docs, text_col, confirm, confirm_fn)
    return (explode_rows(docs, [F.col(id_col)], v, "seq", "v")
            .select(id_col, F.col("seq").cast("int").alias("seq"), "v.pii_type", "v.span_start",
                    "v.span_end", "v.text", "v.severity", "v.confidence"))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """P4 over a table: (id, redacted_text, n_redactions)."""
    v = pii_violations_of(docs, text_col)
    return (docs.select(F.col(id_col), F.col(text_col), v.alias("_pii"))
            .select(id_col,
                    redact(F.col(text_col), F.col("_pii")).alias("redacted_text"),
                    F.size("_pii").alias("n_redactions")))
