import json
import os
import tempfile

from pyspark.sql import functions as F

from clausewise.sources import ingest
from clausewise.sources.reference_texts import read_reference_texts


def test_read_corpus_labels_and_reference_texts(spark):
    d = tempfile.mkdtemp(prefix="clausewise-src-")
    with open(os.path.join(d, "contract_01.txt"), "w") as f:
        f.write("CONTRACT\n\nTERMINATION: yes")
    with open(os.path.join(d, "contract_01.json"), "w") as f:
        json.dump({"document_type": "contract", "pii_spans": [], "violations": []}, f)
    with open(os.path.join(d, "POLICY_9.md"), "w") as f:
        f.write("policy body")
    docs = {r.doc_id: r.text for r in ingest.read_corpus(spark, d).collect()}
    assert docs == {"contract_01": "CONTRACT\n\nTERMINATION: yes"}
    labs = ingest.read_labels(spark, os.path.join(d, "*.json")).collect()
    assert labs[0].doc_id == "contract_01" and labs[0].document_type == "contract"
    refs = {r.id: r.text for r in read_reference_texts(spark, d).collect()}
    assert refs["POLICY_9"] == "policy body" and "contract_01" in refs


def test_route_file_type(spark):
    df = spark.createDataFrame([(1, "a/B.PDF"), (2, "x.docx"), (3, "y.doc"), (4, "z.JPEG"), (5, "n.txt"),
                                (6, "http://h.example.com/p/q.html?x=1"), (7, ".bashrc"), (8, "noext"),
                                (9, "https://e.org/a.b/c")], "id long, path string")
    got = {r.id: (r.file_type, r.status) for r in ingest.route_files(df, "path", "id").collect()}
    assert got[1] == ("pdf", "accepted") and got[2][0] == "docx" and got[3][0] == "docx"
    assert got[4][0] == "image" and got[5][0] == "text"
    assert got[6] == ("unsupported", "error") and got[7][0] == "unsupported" and got[9][0] == "unsupported"


def test_blocks_ocr_headings_assembly(spark):
    docs = spark.createDataFrame([(1, "  a  \n\n\n\n b \n\n   ")], "doc_id long, text string")
    blocks = ingest.extract_blocks(docs).orderBy("block_id").collect()
    assert [(b.block_id, b.text) for b in blocks] == [("page_1_block_0", "a"), ("page_1_block_1", "b")]
    ocr = spark.createDataFrame([(1, 0, "low", 0.5, [[0.0, 1.0], [2.0, 1.0], [2.0, 3.0], [0.0, 3.0]]),
                                 (1, 1, "high", 0.51, [[0.0, 1.0], [2.0, 1.0], [2.0, 3.0], [0.0, 3.0]])],
                                "doc_id long, idx int, text string, confidence double, bbox array<array<double>>")
    o = ingest.ocr_blocks(ocr).collect()
    assert len(o) == 1 and o[0].block_id == "ocr_block_1" and (o[0].bbox.x1, o[0].bbox.y2) == (0.0, 3.0)
    styles = spark.createDataFrame([("Heading 1",), ("Normal",), (None,)], "s string")
    assert [r.t for r in styles.select(ingest.heading_type(F.col("s")).alias("t")).collect()] == [
        "header", "paragraph", "paragraph"]
    b = spark.createDataFrame([(1, i, f"t{i}", "header" if i < 7 else "paragraph") for i in range(3000)] +
                              [(2, 0, "only", "paragraph")], "doc_id long, pos long, text string, block_type string")
    out = {r.doc_id: r for r in ingest.assemble_documents(b, run=1000).collect()}
    assert out[1].full_text == "\n\n".join(f"t{i}" for i in range(3000)) and out[1].n_blocks == 3000
    assert out[1].headers == ["t0", "t1", "t2", "t3", "t4"] and out[2].total_pages == 1 and out[2].headers == []


def test_pseudonymise_and_error_rows(spark):
    up = spark.createDataFrame([("alice", None, "7"), (None, "HR", None)], "u string, d string, id string")
    rows = ingest.pseudonymise(up, "u", "d", "id").collect()
    import hashlib
    assert rows[0].uploader_id == hashlib.sha256(b"alice").hexdigest()[:16] and rows[0].department == "unknown"
    assert rows[1].uploader_id == hashlib.sha256(b"anonymous").hexdigest()[:16] and len(rows[1].processing_id) == 36
    docs = spark.createDataFrame([(1, None), (2, "  "), (3, "ok")], "doc_id long, text string")
    st = {r.doc_id: r.status for r in ingest.error_rows(docs).collect()}
    assert st == {1: "error", 2: "error", 3: "ok"}
