"""Stored vector tables (templates, violation history) with replace-by-id.

A table is a folder of parquet: `data/version=N/bucket=B/` and `commits/version=N/`.
A version is a delta (records added or replaced) or a base (a compaction of all before
it).  It counts once its commit row is there, and writing a version again replaces it as a
whole, so a repeated job or micro-batch changes nothing.  A reader takes the last
base and the deltas after it; of each id the last version's record counts, within one
version the last stored.  Records are bucketed by a hash of their id, so a look-up
reads the buckets of its ids only.  One writer at a time; readers may come any time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions.embedders import Embedder
from clausewise.functions.text import explode_rows
from clausewise.functions.vectors import DEFAULT_DIM
from clausewise.operators.drift import embedded
from clausewise.operators.vectors import upsert_vectors
from clausewise.session import written

SCHEMA = "id string, text string, embedding array<double>, metadata string, stored_at timestamp"
COLUMNS = ["id", "text", "embedding", "metadata", "stored_at"]
TASK_RECORDS = 20_000   # records, of some kilobytes each, sorted and written by one task
COMMIT = "kind string, records long, version long"


def bucket_of(ids: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


class VectorTable:
    """A stored table at `path`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def commits(self) -> list[tuple[int, str]]:
        """(version, base or delta) of the committed versions, ascending: a row per
        version since the last clean-up, whatever the table's size."""
        if not self._exists(f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").select("version", "kind").collect()
        return sorted((r["version"], r["kind"]) for r in rows)

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _write(self, records: DataFrame, version: int, kind: str, n_records: int) -> None:
        """A bucket is written by as many tasks as keep each at about TASK_RECORDS."""
        shares = max(1, math.ceil(n_records / (self.buckets * TASK_RECORDS)))
        share = F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.lit(shares))
        out = records.select(*COLUMNS, bucket_of(F.col("id"), self.buckets).alias("bucket"))
        (out.repartition(self.buckets * shares, "bucket", share).sortWithinPartitions("bucket", "id")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}"))
        n = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/data/version={version}").count()
        commit = self.spark.createDataFrame([(kind, n)], "kind string, records long")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")

    def upsert(self, records: DataFrame, version: int | None = None, dim: int = DEFAULT_DIM, embedder: Embedder | None = None) -> int:
        """Add or replace records (`records_of`) as one delta; `version`
        (default: the next) makes a repeated write replace itself.  Records without
        vectors are embedded from their text here, when they are told apart by id."""
        version = self.next_version() if version is None else version
        bases = [v for v, kind in self.commits() if kind == "base"]
        if bases and version <= bases[-1]:
            if version == bases[-1]:
                raise ValueError(f"version {version} is a base")
            return version  # compacted already: the base holds it
        records = written(records, "vector-records")
        n = records.count()
        # a task per TASK_RECORDS records, whatever the session's width
        last = upsert_vectors(records.repartition(max(1, math.ceil(n / TASK_RECORDS)), "id"), "id", ("stored_at", "text"))
        if "embedding" not in records.columns:
            last = last.withColumn("embedding", embedded(F.col("text"), dim, embedder))
        self._write(last, version, "delta", n)
        return version

    def next_version(self) -> int:
        return max([v for v, _ in self.commits()], default=-1) + 1

    def read(self, as_of: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The last record of each id, of all versions up to `as_of`."""
        commits = [c for c in self.commits() if as_of is None or c[0] <= as_of]
        first = max([v for v, kind in commits if kind == "base"], default=None)
        paths = [f"{self.path}/data/version={v}" for v, _ in commits if first is None or v >= first]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(f"{SCHEMA}, version long, bucket int").parquet(*paths)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        if len(paths) == 1:
            return rows.select(*COLUMNS)
        return upsert_vectors(rows.select(*COLUMNS, "version"), "id", ("version",)).select(*COLUMNS)

    def lookup(self, ids: list[str]) -> DataFrame:
        """The records of a short list of ids: only their buckets are read."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        held = [r["b"] for r in asked.select(bucket_of(F.col("id"), self.buckets).alias("b")).distinct().collect()]
        return self.read(buckets=held).where(F.col("id").isin(list(ids)))

    def compact(self) -> int:
        """Write all that counts as a base, so readers need no older version."""
        version = self.next_version()
        rows = self.read()
        self._write(rows, version, "base", rows.count())
        return version


def records_of(rows: DataFrame, id_col: str, text_col: str | None = "text", embedding_col: str | None = None, stored_at: Column | None = None,
               metadata: Column | None = None, dim: int = DEFAULT_DIM, embedder: Embedder | None = None) -> DataFrame:
    """Records of a vector table: vectors as supplied, else embedded from the text."""
    text = F.col(text_col).cast("string") if text_col else F.lit(None).cast("string")
    vector = F.col(embedding_col).cast("array<double>") if embedding_col else embedded(text, dim, embedder)
    at = F.current_timestamp() if stored_at is None else stored_at
    return rows.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), vector.alias("embedding"),
                       (F.lit(None) if metadata is None else metadata).cast("string").alias("metadata"), at.cast("timestamp").alias("stored_at"))


def violation_records(audits: DataFrame, run_id: str, id_col: str = "doc_id", stored_at: Column | None = None) -> DataFrame:
    """An audit's violations as history records: searched by their matched text, else
    their message; the id is fixed by run, document and place, so storing a run
    twice stores it once.  They have no vectors yet: `VectorTable.upsert` embeds them."""
    from clausewise.plans.audit import search_text
    long = explode_rows(audits, [id_col], F.col("violations"))
    key = F.sha2(F.concat_ws("|", F.lit(run_id), F.col(id_col).cast("string"), F.col("v.seq").cast("string")), 256)
    told = F.to_json(F.struct(F.col(id_col).alias("doc_id"), F.col("v.type").alias("type"), F.col("v.rule_id").alias("rule_id"), F.col("v.severity").alias("severity")))
    rows = long.select(F.substring(key, 1, 32).alias("id"), search_text(F.col("v")).alias("text"), told.alias("metadata"))
    return records_of(rows, "id", "text", stored_at=stored_at, metadata=F.col("metadata")).drop("embedding")
