"""V1: PII precision / recall against labelled spans.

Per document: a labelled span is a true positive if its text is a substring
of some detected span's text, else a false negative; a detection is a false
positive if it contains no labelled text.  Micro-averaged over documents;
each ratio is 0 on a zero denominator.  Per-document counts are narrow array
expressions; the totals are one global aggregate (partial per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pii_match_counts(detected: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """detected(id, det: array<string> or det_counts: array<struct<text, n>>),
    labels(id, gt: array<string>) -> (id, tp, fn, fp).  Documents missing on
    one side count as empty.  With `det_counts`, repeated detection texts
    are collapsed beforehand and a false positive weighs its count."""
    j = labels.join(detected, id_col, "full_outer")
    gt = F.coalesce(F.col("gt"), F.array().cast("array<string>"))
    if "det_counts" in detected.columns:
        det = F.coalesce(F.col("det_counts"), F.array().cast("array<struct<text:string,n:bigint>>"))
    else:
        det = F.transform(F.coalesce(F.col("det"), F.array().cast("array<string>")),
                          lambda d: F.struct(d.alias("text"), F.lit(1).cast("bigint").alias("n")))
    found = F.filter(gt, lambda g: F.exists(det, lambda d: F.contains(d["text"], g)))
    fp = F.aggregate(F.filter(det, lambda d: ~F.exists(gt, lambda g: F.contains(d["text"], g))),
                     F.lit(0).cast("bigint"), lambda acc, d: acc + d["n"])
    return j.select(id_col, F.size(found).cast("bigint").alias("tp"),
                    (F.size(gt) - F.size(found)).cast("bigint").alias("fn"),
                    fp.cast("bigint").alias("fp"))


def detection_counts(spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Detections per document as distinct (text, count) pairs; the count is
    partially aggregated before the shuffle, so a document whose detections
    repeat the same text many times stays a small group."""
    return (spans.groupBy(id_col, text_col).agg(F.count(F.lit(1)).alias("n"))
            .groupBy(id_col).agg(F.collect_list(F.struct(F.col(text_col).alias("text"), "n")).alias("det_counts")))


def row_match_counts(gt_texts, det_texts):
    """Per-row (tp, fn, fp) when a row already holds its labelled texts and
    its detected texts (arrays): no join, no grouping."""
    gt = F.coalesce(gt_texts, F.array().cast("array<string>"))
    det = F.coalesce(det_texts, F.array().cast("array<string>"))
    found = F.filter(gt, lambda g: F.exists(det, lambda d: F.contains(d, g)))
    fp = F.filter(det, lambda d: ~F.exists(gt, lambda g: F.contains(d, g)))
    return F.struct(F.size(found).cast("bigint").alias("tp"),
                    (F.size(gt) - F.size(found)).cast("bigint").alias("fn"),
                    F.size(fp).cast("bigint").alias("fp"))


def evaluate_pii_rows(df: DataFrame, gt_col: str = "gt", det_col: str = "det") -> DataFrame:
    """V1 when labels and detections sit in the same row (e.g. the audit of a
    labelled corpus): narrow per-row counts, then one global aggregate."""
    m = df.select(row_match_counts(F.col(gt_col), F.col(det_col)).alias("m")).select("m.*")
    return _metrics(m)


def evaluate_pii(detected: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return _metrics(pii_match_counts(detected, labels, id_col))


def _metrics(counts: DataFrame) -> DataFrame:
    c = counts.agg(
        F.sum("tp").cast("bigint").alias("tp"), F.sum("fp").cast("bigint").alias("fp"),
        F.sum("fn").cast("bigint").alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return (c.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))
            .select("tp", "fp", "fn", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1")))
