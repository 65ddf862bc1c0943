"""Document-type classification (projection only, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.text import contains_any

# Fixed values (must equal the reference's classifier): ordered type tests on
# the lower-cased first 1000 characters; first hit wins.
TYPE_KEYWORDS = [
    ("contract", ["contract", "agreement", "terms and conditions"]),
    ("policy", ["policy", "procedure", "guideline"]),
    ("invoice", ["invoice", "bill", "payment", "amount due"]),
    ("hr_form", ["employee", "hr", "human resources", "approval form"]),
]
PREFIX_CHARS = 1000
MATCH_CONFIDENCE = 0.9
UNKNOWN_CONFIDENCE = 0.5


def classify(text: Column, prefix_chars: int | None = PREFIX_CHARS) -> Column:
    """struct<document_type:string, confidence:double> for one text column.
    The reference's rule reads the first 1000 characters; `prefix_chars=None`
    reads the whole text."""
    src = F.coalesce(text, F.lit(""))
    head = F.lower(src if prefix_chars is None else F.substring(src, 1, prefix_chars))
    doc_type = F.lit("unknown")
    for name, words in reversed(TYPE_KEYWORDS):
        doc_type = F.when(contains_any(head, words), F.lit(name)).otherwise(doc_type)
    conf = F.when(doc_type == "unknown", F.lit(UNKNOWN_CONFIDENCE)).otherwise(F.lit(MATCH_CONFIDENCE))
    return F.struct(doc_type.alias("document_type"), conf.alias("confidence"))


def classify_documents(docs: DataFrame, text_col: str = "text", prefix_chars: int | None = PREFIX_CHARS) -> DataFrame:
    """Add `document_type` and `classification_confidence`."""
    c = classify(F.col(text_col), prefix_chars)
    return (docs.withColumn("_cls", c)
            .withColumn("document_type", F.col("_cls.document_type"))
            .withColumn("classification_confidence", F.col("_cls.confidence"))
            .drop("_cls"))
