"""A1-A2: violation scoring and the approve / fix / review / reject decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's approval rules).
SEVERITY_WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}
DEFAULT_WEIGHT = 1          # unknown severities weigh like low
MISSING_SEVERITY = "low"    # absent severity is treated as low
AUTO_FIX_MAX_SCORE = 2
REVIEW_MAX_SCORE = 5
DECISIONS = ["Auto-Approve", "Auto-Fix", "Require Review", "Reject"]


def severity_weight(sev: Column) -> Column:
    s = F.coalesce(sev, F.lit(MISSING_SEVERITY))
    w = F.lit(DEFAULT_WEIGHT)
    for name, weight in SEVERITY_WEIGHTS.items():
        w = F.when(s == name, F.lit(weight)).otherwise(w)
    return w


def severity_bucket(sev: Column) -> Column:
    """critical/high/medium, everything else (missing, unknown) counts as low."""
    s = F.coalesce(sev, F.lit(MISSING_SEVERITY))
    return F.when(s.isin("critical", "high", "medium"), s).otherwise(F.lit("low"))


def score(violations: Column) -> Column:
    """A1: struct<violation_score, critical, high, medium, low> (ints)."""
    total = F.aggregate(violations, F.lit(0), lambda acc, v: acc + severity_weight(v["severity"]))

    def count(bucket: str) -> Column:
        return F.size(F.filter(violations, lambda v: severity_bucket(v["severity"]) == bucket))

    return F.struct(total.alias("violation_score"), count("critical").alias("critical"),
                    count("high").alias("high"), count("medium").alias("medium"),
                    count("low").alias("low"))


def decide(violation_score: Column, n_suggestions: Column) -> Column:
    """A2: struct<decision, reason>."""
    pts = violation_score.cast("string")
    decision = (F.when(violation_score == 0, F.lit("Auto-Approve"))
                .when((violation_score <= AUTO_FIX_MAX_SCORE) & (n_suggestions > 0), F.lit("Auto-Fix"))
                .when(violation_score <= REVIEW_MAX_SCORE, F.lit("Require Review"))
                .otherwise(F.lit("Reject")))
    reason = (F.when(violation_score == 0, F.lit("No violations detected"))
              .when((violation_score <= AUTO_FIX_MAX_SCORE) & (n_suggestions > 0),
                    F.concat(F.lit("Low severity violations ("), pts, F.lit(" points) with available fixes")))
              .when(violation_score <= REVIEW_MAX_SCORE,
                    F.concat(F.lit("Medium severity violations ("), pts,
                             F.lit(" points) require human review")))
              .otherwise(F.concat(F.lit("High severity violations ("), pts,
                                  F.lit(" points) cannot be auto-fixed"))))
    return F.struct(decision.alias("decision"), reason.alias("reason"))
