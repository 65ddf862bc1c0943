"""The common violation / suggestion structs shared by all scanners.

Absent keys of the per-scanner records are NULL fields, so every scanner's
output has the same type and the merge is a plain array `concat`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATION_TYPE = T.StructType([
    T.StructField("seq", T.IntegerType()),
    T.StructField("scanner", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("pii_type", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("check_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("span_start", T.IntegerType()),
    T.StructField("span_end", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
])

SUGGESTION_TYPE = T.StructType([
    T.StructField("violation_id", T.StringType()),
    T.StructField("span_start", T.IntegerType()),
    T.StructField("span_end", T.IntegerType()),
    T.StructField("original_text", T.StringType()),
    T.StructField("replacement", T.StringType()),
    T.StructField("explanation", T.ArrayType(T.StringType())),
    T.StructField("citations", T.ArrayType(T.StringType())),
    T.StructField("redaction_flag", T.BooleanType()),
])


def _typed(value, dtype: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(value, Column):
        return value.cast(dtype)
    return F.lit(value).cast(dtype)


def violation(**fields) -> Column:
    """Build one violation struct; unspecified fields are NULL."""
    unknown = set(fields) - set(VIOLATION_TYPE.fieldNames())
    if unknown:
        raise ValueError(f"unknown violation fields: {sorted(unknown)}")
    return F.struct(*[
        _typed(fields.get(f.name), f.dataType).alias(f.name) for f in VIOLATION_TYPE.fields
    ])


def empty_violations() -> Column:
    return F.array().cast(T.ArrayType(VIOLATION_TYPE))


def number(arr: Column) -> Column:
    """Set `seq` to the position in the merged list (0-based)."""
    return F.transform(arr, lambda v, i: v.withField("seq", i))
