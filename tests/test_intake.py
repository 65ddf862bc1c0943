"""From files to audit rows: incremental runs, failures, decoded blocks, look-ups."""

import os
import uuid

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from clausewise.plans.audit import audit
from clausewise.plans.intake import audit_files
from clausewise.session import checkpoint_dir
from clausewise.sources import ingest
from clausewise.sources.reference_texts import read_reference_texts


def put(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)


def test_each_file_is_audited_once(spark, tmp_path):
    inbox, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(inbox, {"a one.txt": "First.\n\nmail a@b.example\n\n\n\n", "b+2.TXT": "  \n\n ", "c.zip": "zz", "d.pdf": "%PDF", "e%41.txt": "x" * 20, "noext": "t", "f.pdf": "%PDF"})
    about = spark.createDataFrame([("a one.txt", "ann", "legal"), ("d.pdf", None, None)], "name string, uploader string, department string")
    decoded = spark.createDataFrame([("d.pdf", 1, 0, "Heading", "header"), ("d.pdf", 2, 1, "This contract has no end.", "paragraph"), ("zzz.pdf", 1, 0, "other", "paragraph")],
                                    "name string, page int, pos int, text string, block_type string")
    rows = {r.name: r for r in audit_files(spark, inbox, out, "r1", about, decoded).collect()}
    assert {n: (r.status, r.error) for n, r in rows.items()} == {
        "a one.txt": ("ok", None), "b+2.TXT": ("error", "document text is empty"), "c.zip": ("error", "Unsupported file type: .zip"), "d.pdf": ("ok", None),
        "e%41.txt": ("ok", None), "noext": ("error", "Unsupported file type: "), "f.pdf": ("error", "no decoded blocks of f.pdf")}
    a, d = rows["a one.txt"], rows["d.pdf"]
    assert (a.doc_id, a.department, a.n_blocks, a.total_pages, list(a.headers)) == ("a one", "legal", 2, 1, [])
    assert (d.total_pages, list(d.headers), d.department) == (2, ["Heading"], "unknown") and d.uploader_id != a.uploader_id
    want = audit(spark.createDataFrame([("a one", "First.\n\nmail a@b.example"), ("d", "Heading\n\nThis contract has no end.")], "doc_id string, text string"))
    assert {r.doc_id: r.violation_score for r in want.collect()} == {"a one": a.violation_score, "d": d.violation_score}
    full = spark.read.parquet(f"{out}/audit_full").where("run_id = 'r1'")
    assert full.where("doc_id = 'd'").first().document_type == "contract" and full.count() == 3
    assert audit_files(spark, inbox, out, "r2", about, decoded).count() == 0      # nothing new
    again = audit_files(spark, inbox, out, "r1", about, decoded)                   # the run repeated: the same rows
    assert {r.name: r.violation_score for r in again.collect()} == {n: r.violation_score for n, r in rows.items()}
    put(inbox, {"g.txt": "A new agreement."})
    assert [r.name for r in audit_files(spark, inbox, out, "r3").collect()] == ["g.txt"]
    assert spark.read.parquet(f"{out}/manifest").count() == 8
    assert spark.read.parquet(f"{out}/audit_files").groupBy("run_id").count().count() == 2


def test_an_empty_inbox(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    assert audit_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", "r1").count() == 0


def test_a_look_up_reads_few_row_groups(spark):
    out = f"{checkpoint_dir(spark)}/look-{uuid.uuid4().hex}"
    docs = spark.range(4000).select(F.xxhash64("id").alias("doc_id"), F.concat(F.lit("document "), F.col("id").cast("string")).alias("text"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table stays in several files
    try:
        paths = ingest.write_audit(audit(docs, with_drift=False), out, "r")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    asked = [r.doc_id for r in docs.limit(3).collect()]
    ranges = []
    for file in spark.read.parquet(paths["audit_results"]).inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        column = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "doc_id")
        ranges += [(s.min, s.max) for s in (meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups))]
    for i in asked:
        assert len(ranges) >= 4 and sum(a <= i <= b for a, b in ranges) == 1
    got = ingest.audit_status(spark, paths["audit_results"], [*asked, 5])
    assert sorted(r.status for r in got.collect()) == ["completed"] * 3 + ["not_found"]


def test_only_the_last_suffix_goes(spark, tmp_path):
    put(f"{tmp_path}/p", {"notes.mdx.txt": "a", "a.md.txt": "b", "b.md": "c", "c.mdx": "d"})
    assert {r.id: r.text for r in read_reference_texts(spark, f"{tmp_path}/p").collect()} == {"notes.mdx": "a", "a.md": "b", "b": "c"}
