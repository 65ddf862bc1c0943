"""Signature fields, image hint, missing-signature violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.functions.text import contains_any, explode_rows, finditer
from clausewise.functions.violations import empty_violations, violation

# Fixed values (must equal the reference's checker).  Patterns are matched
# case-insensitively and counted independently of each other.
SIGNATURE_PATTERNS = [r"signed\s+by", r"signature", r"approved\s+by", r"authorized\s+signature"]
IMAGE_HINT_WORD = "signature"
IMAGE_WORDS = ["image", "png", "jpg"]
IMAGE_HINT_CONFIDENCE = 0.7
SIGNATURE_REQUIRED_TYPES = ["contract", "hr_form", "agreement", "policy"]

HIT_TYPE = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("span_start", T.IntegerType()),
    T.StructField("span_end", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
]))


def signature_hits(text: Column) -> Column:
    """G1+G2: array<struct<type, span_start, span_end, text, confidence>>."""
    per_pattern = [
        F.transform(finditer(text, p, ignore_case=True), lambda s: F.struct(
            F.lit("signature_field").alias("type"), s["span_start"].alias("span_start"),
            s["span_end"].alias("span_end"), s["text"].alias("text"),
            F.lit(None).cast("double").alias("confidence")))
        for p in SIGNATURE_PATTERNS
    ]
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hint = F.when(
        lowered.contains(IMAGE_HINT_WORD) & contains_any(lowered, IMAGE_WORDS),
        F.array(F.struct(F.lit("signature_image").alias("type"), F.lit(None).cast("int").alias("span_start"),
                         F.lit(None).cast("int").alias("span_end"), F.lit(None).cast("string").alias("text"),
                         F.lit(IMAGE_HINT_CONFIDENCE).alias("confidence"))),
    ).otherwise(F.array().cast(HIT_TYPE))
    return F.concat(*per_pattern, hint).cast(HIT_TYPE)


def signature_violations(text: Column, doc_type: Column, hits: Column) -> Column:
    """A single high-severity violation when a required signature is absent."""
    t = F.coalesce(doc_type, F.lit(""))
    missing = t.isin(SIGNATURE_REQUIRED_TYPES) & (F.size(hits) == 0)
    return F.when(missing, F.array(violation(
        scanner="signature", type="missing_signature", severity="high",
        message=F.concat(t, F.lit(" document missing required signature/approval")),
        span_start=F.lit(0), span_end=F.length(F.coalesce(text, F.lit("")))))
    ).otherwise(empty_violations())


def find_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per signature hit."""
    return (explode_rows(docs, [id_col], signature_hits(F.col(text_col)), "seq", "h")
            .select(id_col, F.col("seq").cast("int").alias("seq"), "h.type", "h.span_start",
                    "h.span_end", "h.text", "h.confidence"))


def missing_signatures(docs: DataFrame, type_col: str = "document_type", id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document whose required signature is missing."""
    hits = signature_hits(F.col(text_col))
    v = signature_violations(F.col(text_col), F.col(type_col), hits)
    return (explode_rows(docs, [id_col, type_col], v)
            .select(id_col, type_col, "v.type", "v.severity", "v.message", "v.span_start", "v.span_end"))
