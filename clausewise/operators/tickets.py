"""K1-K3: the human-review queue as tables.

Tickets are derived deterministically from audit results; status changes are
an append-only update table merged with "last update wins" (ts, then
event id), which is a partial aggregate (`max_by`) before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.operators.decide import SEVERITY_WEIGHTS

OPEN = "open"
REVIEW_DECISION = "Require Review"


def review_queue(audits: DataFrame, run_id: str, id_col: str = "doc_id",
                 department_col: str | None = None, created_at: str = "2024-01-01 00:00:00") -> DataFrame:
    """K1: one open ticket per document decided 'Require Review'.
    ticket_id = sha256(doc id | run id)[:32]; severity = the highest
    severity among its violations; summary = violation types and count."""
    worst = F.aggregate(
        F.transform("violations", lambda v: F.struct(
            _weight(v["severity"]).alias("w"), F.coalesce(v["severity"], F.lit("low")).alias("s"))),
        F.struct(F.lit(-1).alias("w"), F.lit(None).cast("string").alias("s")),
        lambda acc, x: F.when(x["w"] > acc["w"], x).otherwise(acc))["s"]
    types = F.array_join(F.array_sort(F.array_distinct(F.transform("violations", lambda v: v["type"]))), ", ")
    doc = F.col(id_col).cast("string")
    return (audits.where(F.col("decision") == REVIEW_DECISION).select(
        F.substring(F.sha2(F.concat(doc, F.lit("|"), F.lit(run_id)), 256), 1, 32).alias("ticket_id"),
        doc.alias("document_id"),
        F.lit(run_id).alias("processing_id"),
        F.lit(OPEN).alias("status"),
        F.to_timestamp(F.lit(created_at)).alias("created_at"),
        F.concat(F.size("violations").cast("string"), F.lit(" violation(s): "), types).alias("violation_summary"),
        worst.alias("severity"),
        (F.col(department_col) if department_col else F.lit(None).cast("string")).alias("department"),
        F.lit(None).cast("string").alias("assignee"),
    ))


def _weight(sev):
    w = F.lit(1)
    for name, weight in SEVERITY_WEIGHTS.items():
        w = F.when(sev == name, F.lit(weight)).otherwise(w)
    return w


def list_tickets(tickets: DataFrame, status: str | None = None, ticket_id: str | None = None) -> DataFrame:
    """K2: optional equality filters (pushed down to the scan when stored)."""
    out = tickets
    if status:
        out = out.where(F.col("status") == status)
    if ticket_id:
        out = out.where(F.col("ticket_id") == ticket_id)
    return out


def update_ticket_status(tickets: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K3: apply status updates (event_id, ts, ticket_id, status): the latest
    update per ticket wins.  Returns (tickets with current status, number of
    rejected updates per unknown ticket id and status).  Updates are combined
    per ticket before they move, so a hot ticket is no hot key."""
    latest = updates.groupBy("ticket_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("_new_status"),
        F.count(F.lit(1)).cast("bigint").alias("n_updates"))
    current = (tickets.join(latest, "ticket_id", "left")
               .withColumn("status", F.coalesce("_new_status", "status"))
               .withColumn("n_updates", F.coalesce("n_updates", F.lit(0).cast("bigint")))
               .drop("_new_status"))
    per_status = updates.groupBy("ticket_id", "status").agg(F.count(F.lit(1)).cast("bigint").alias("n_updates"))
    rejected = per_status.join(tickets.select("ticket_id"), "ticket_id", "left_anti")
    return current, rejected
