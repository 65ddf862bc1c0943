"""Q4: running counters over an event stream.

Event-time tumbling windows with a watermark bound the state; rows later than
the watermark are not counted (documented choice).  Counters leave in update
mode, so windows that are still open when the input ends are complete too."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.session import checkpoint_dir
from clausewise.streaming.audit_stream import _glob



WINDOW = "1 day"
WATERMARK = "1 hour"


def event_metrics_stream(spark: SparkSession, source_path: str, out_dir: str, checkpoint: str,
                         window: str = WINDOW, watermark: str = WATERMARK):
    """Windowed counts per event type (update mode): each micro-batch appends
    the counters it changed, with its batch id, so the open windows at the end of the
    input are there too; the watermark only bounds the state."""
    schema = spark.read.parquet(source_path).schema
    ev = (spark.readStream.schema(schema).option("basePath", os.path.dirname(source_path)).parquet(_glob(source_path))
          .withColumn("ts", F.col("ts").cast("timestamp")))  # a watermark needs a time with zone: the session's
    agg = (ev.withWatermark("ts", watermark)
           .groupBy(F.window("ts", window).alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type",
                      "n_events", "total_value", F.lit(batch_id).alias("batch_id"))
         .write.mode("append").parquet(out_dir))

    return (agg.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest batch's row of each counter (a replayed batch changes nothing)."""
    others = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others if c != "batch_id"])


def run_event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{checkpoint_dir(spark)}/event-metrics-{uuid.uuid4().hex}"
    q = event_metrics_stream(spark, f"{sf_dir}/events.parquet", f"{base}/out", f"{base}/chk")
    q.awaitTermination()
    return current_counters(spark.read.parquet(f"{base}/out"), ["window_start", "window_end", "event_type"])


def severity_counts_stream_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 over the audit stream: violations per severity in processing-time
    windows, kept as streaming state (update mode).  Each micro-batch's
    updated counts are appended to a table in the shared folder with their
    batch id; the current value of a (window, severity) counter is its row
    from the latest batch.  Returns totals per severity."""
    from clausewise.plans.audit import audit

    base = os.path.join(checkpoint_dir(spark), f"severity-stream-{uuid.uuid4().hex}")
    src = os.path.join(sf_dir, "documents.parquet")
    schema = spark.read.parquet(src).select("doc_id", "text").schema
    stream = (spark.readStream.schema(schema).option("basePath", os.path.dirname(src))
              .parquet(_glob(src)).select("doc_id", "text"))
    audited = audit(stream).select(F.current_timestamp().alias("audited_at"), "violations")
    counts = (audited.withWatermark("audited_at", WATERMARK)
              .select("audited_at", F.posexplode_outer("violations").alias("_p", "v"))
              .where(F.col("_p").isNotNull())
              .groupBy(F.window("audited_at", WINDOW).alias("w"),
                       F.coalesce(F.col("v.severity"), F.lit("unknown")).alias("severity"))
              .agg(F.count(F.lit(1)).alias("violations")))
    out = f"{base}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start"), "severity", "violations",
                      F.lit(batch_id).alias("batch_id"))
         .write.mode("append").parquet(out))

    q = (counts.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(out)
    return current_counters(rows, ["window_start", "severity"]).groupBy("severity").agg(F.sum("violations").cast("bigint").alias("violations"))


def ticket_status_stream_run(spark: SparkSession, sf_dir: str, run_id: str = "run-0001",
                             status_of=None) -> DataFrame:
    """K3 as a stream: status updates arrive as events; per ticket the state
    keeps the latest status by (ts, event id) and the update count (update
    mode, `max_by` state).  Batches append their changed rows to a table in
    the shared folder; the current state is the latest batch per ticket."""
    base = os.path.join(checkpoint_dir(spark), f"ticket-stream-{uuid.uuid4().hex}")
    src = os.path.join(sf_dir, "events.parquet")
    schema = spark.read.parquet(src).schema
    ev = spark.readStream.schema(schema).option("basePath", os.path.dirname(src)).parquet(_glob(src))
    status = status_of(F.col("event_type")) if status_of else F.col("event_type")
    upd = ev.select("event_id", "ts", F.substring(F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("|"),
                                                                  F.lit(run_id)), 256), 1, 32).alias("ticket_id"),
                    status.alias("status"))
    state = upd.groupBy("ticket_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"),
                                         F.count(F.lit(1)).alias("n_updates"))
    out = f"{base}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (state.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(out)
    return (current_counters(rows, ["ticket_id"]).select("ticket_id", "status", F.col("n_updates").cast("bigint").alias("n_updates")))
