"""O1 audit counters, O2 duration histogram (global aggregates with map-side
partial aggregation: each task emits one partial row, so a skewed input
cannot overload a reducer)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed values (must equal the reference's histogram buckets, seconds).
DURATION_BUCKETS = [1, 5, 10, 30, 60]
SEVERITIES = ["critical", "high", "medium", "low"]
MISSING_SEVERITY_LABEL = "unknown"


def audit_counters(audits: DataFrame) -> DataFrame:
    """One row: documents processed, violations per severity label (missing
    severity counted as 'unknown'), auto-approved and auto-fixed documents."""
    sev_counts = [F.sum(F.size(F.filter("violations", _is(s)))).cast("bigint").alias(f"violations_{s}")
                  for s in SEVERITIES + [MISSING_SEVERITY_LABEL]]
    return audits.agg(
        F.count(F.lit(1)).cast("bigint").alias("documents_processed"),
        F.sum(F.size("violations")).cast("bigint").alias("violations_total"),
        *sev_counts,
        F.count_if(F.col("decision") == "Auto-Approve").cast("bigint").alias("autopasses_total"),
        F.count_if(F.col("decision") == "Auto-Fix").cast("bigint").alias("auto_fix_applied_total"),
    )


def _is(sev: str):
    def pred(v):
        return F.coalesce(v["severity"], F.lit(MISSING_SEVERITY_LABEL)) == sev
    return pred


def duration_histogram(durations: DataFrame, value_col: str = "value") -> DataFrame:
    """Cumulative counts le_1 .. le_60, le_inf, plus sum and count."""
    v = F.col(value_col)
    return durations.agg(
        *[F.count_if(v <= b).cast("bigint").alias(f"le_{b}") for b in DURATION_BUCKETS],
        F.count(v).cast("bigint").alias("le_inf"),
        F.round(F.sum(v), 6).alias("sum"),
        F.count(v).cast("bigint").alias("count"),
    )
