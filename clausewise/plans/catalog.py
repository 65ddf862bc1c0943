"""Registered queries: one per operator of the inventory, each over the whole
driver tables (`(spark, sf_dir) -> DataFrame`).  Integer outputs are bigint
and computed doubles are rounded to 6 decimals so results compare exactly
with the SQL oracle (`plans/oracle.py`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions.text import explode_rows
from clausewise.functions.vectors import DEFAULT_DIM, buckets, dense_from_bag
from clausewise.operators.drift import chunk_table, detect_drift
from clausewise.operators.evaluate import detection_counts, evaluate_pii
from clausewise.operators.metrics import audit_counters, duration_histogram
from clausewise.operators.pii import redact_documents, scan_pii
from clausewise.operators.rewrite import apply_fixes, change_segments
from clausewise.operators.rules import apply_policy_rules, rules_for_types, rules_table
from clausewise.operators.signatures import find_signatures, missing_signatures
from clausewise.operators.tickets import list_tickets, review_queue, update_ticket_status
from clausewise.operators.triage import classify_documents
from clausewise.operators.vectors import approx_candidate_share, approx_top_k_similar, top_k_similar, upsert_vectors
from clausewise.plans.audit import audit, final_text
from clausewise.session import dealt, load_table, written
from clausewise.sources import ingest
from clausewise.sources.corpus import generate_corpus
from clausewise.sources.reference_texts import templates_table

RUN_ID = "run-0001"
TOPK = 3
UPLOADS_PER_TASK = 250   # files that one task writes: each takes some hundredths of a second


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "documents").select("doc_id", "text")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return generate_corpus(dealt(load_table(spark, sf, "customer").select("c_custkey", "c_name")))


def _long(df: DataFrame) -> DataFrame:
    """Cast integral columns to bigint for a stable schema."""
    out = df
    for f in df.schema.fields:
        if f.dataType.typeName() in ("integer", "short", "byte"):
            out = out.withColumn(f.name, F.col(f.name).cast("bigint"))
    return out


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return audit(_docs(spark, sf))


# ------------------------------------------------------------------ triage / PII

def t1_classify(spark, sf):
    d = classify_documents(_docs(spark, sf))
    return d.select("doc_id", "document_type", F.col("classification_confidence").alias("confidence"))


def t1_classify_whole(spark, sf):
    """The classifier over whole texts instead of the reference's prefix."""
    d = classify_documents(_docs(spark, sf), prefix_chars=None)
    return d.groupBy("document_type").agg(F.count(F.lit(1)).alias("n_documents"))


def p1_pii_spans(spark, sf):
    return _long(scan_pii(_docs(spark, sf)))


def p1_pii_spans_pages(spark, sf):
    pages = load_table(spark, sf, "pages")
    return _long(scan_pii(pages, id_col="page_id", text_col="html"))


def p3_confirm_pii(spark, sf):
    return _long(scan_pii(_docs(spark, sf), confirm=True))


def _account_notes(spark, sf):
    """A note with an account number, an IBAN and a social security number per customer."""
    k = F.col("c_custkey").cast("bigint")
    return load_table(spark, sf, "customer").select(k.alias("doc_id"), F.concat(
        F.lit("Account "), F.lpad(k.cast("string"), 9, "7"), F.lit(", IBAN GB"), F.lpad((k % 100).cast("string"), 2, "0"),
        F.lit("NWBK"), F.lpad(k.cast("string"), 14, "6"), F.lit(", SSN "), F.lpad((k % 1000).cast("string"), 3, "4"),
        F.lit("-55-"), F.lpad((k % 10000).cast("string"), 4, "1"), F.lit(".")).alias("text"))


def p3_confirm_pii_notes(spark, sf):
    return _long(scan_pii(_account_notes(spark, sf), confirm=True))


def p4_redact(spark, sf):
    return _long(redact_documents(_docs(spark, sf)))


# ------------------------------------------------------------------ rules / signatures

def r1_rules_for_type(spark, sf):
    types = classify_documents(_docs(spark, sf)).groupBy("document_type").agg(
        F.count(F.lit(1)).alias("n_documents"))
    corpus_types = _corpus(spark, sf).groupBy("document_type").agg(F.count(F.lit(1)).alias("n_documents"))
    both = types.unionByName(corpus_types).groupBy("document_type").agg(F.sum("n_documents").alias("n_documents"))
    return _long(rules_for_types(both, rules_table(spark)).select(
        "document_type", "n_documents", "rule_id", "check_id", "severity"))


def r7_policy_violations(spark, sf):
    return _long(apply_policy_rules(classify_documents(_docs(spark, sf))))


def r7_policy_violations_corpus(spark, sf):
    c = _corpus(spark, sf).select("doc_id", "text")
    return _long(apply_policy_rules(classify_documents(c)))


def g1_signatures(spark, sf):
    return _long(find_signatures(_docs(spark, sf)))


def g1_signatures_corpus(spark, sf):
    return _long(find_signatures(_corpus(spark, sf).select("doc_id", "text")))


def g3_missing_signature(spark, sf):
    return _long(missing_signatures(classify_documents(_docs(spark, sf))))


def g3_missing_signature_corpus(spark, sf):
    return _long(missing_signatures(classify_documents(_corpus(spark, sf).select("doc_id", "text"))))


# ------------------------------------------------------------------ chunks / vectors / drift

def d1_chunks(spark, sf):
    return _long(chunk_table(_docs(spark, sf)))


def d1_chunks_lines(spark, sf):
    return _long(chunk_table(_docs(spark, sf), sep="\n"))


def d2_embed_benchmark(spark, sf):
    """Hashed bag-of-words embedding of `benchmark` as sparse rows."""
    b = load_table(spark, sf, "benchmark")
    bag = F.col("bag")
    e = b.select("item_id", buckets(F.col("text"), DEFAULT_DIM).alias("bag")).select(
        "item_id", "bag", dense_from_bag(bag, DEFAULT_DIM).alias("vec"))
    rows = explode_rows(e, ["item_id", "bag"], F.col("vec"), "bucket", "w").where("w > 0")
    return _long(rows.select("item_id", "bucket", F.size(F.filter(bag, lambda x: x == F.col("bucket"))).alias("cnt"),
                             F.round("w", 6).alias("weight")))


def _topk(spark, sf, metric):
    e = load_table(spark, sf, "embeddings")
    r = top_k_similar(e.select(F.col("vec_id").alias("query_id"), "embedding"),
                      e.select(F.col("vec_id").alias("id"), "embedding"), TOPK, metric=metric,
                      exclude_self=True)
    return _long(r.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"),
                          F.round("distance", 6).alias("distance")))


def d3_topk_l2(spark, sf):
    return _topk(spark, sf, "l2")


def d3_topk_cosine(spark, sf):
    return _topk(spark, sf, "cosine")


def d3b_approx_topk(spark, sf):
    e = load_table(spark, sf, "embeddings")
    r = approx_top_k_similar(e.select(F.col("vec_id").alias("query_id"), "embedding"),
                             e.select(F.col("vec_id").alias("id"), "embedding"), TOPK, exclude_self=True)
    return _long(r.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity")))


def d3b_recall(spark, sf):
    """Recall and scored pairs of the approximate search against the exact one
    over all embeddings: at least 0.9 of the 3 nearest, under a quarter of all pairs."""
    e = load_table(spark, sf, "embeddings")
    q, store = e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding")
    exact = top_k_similar(q, store, TOPK, exclude_self=True).select("query_id", "id")
    found = approx_top_k_similar(q, store, TOPK, exclude_self=True).select("query_id", "id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours"),
                                                             (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"))
    return hits.join(approx_candidate_share(q, store).select((F.col("share") < 0.25).alias("share_ok")))


def d4_drift(spark, sf):
    return _long(detect_drift(_docs(spark, sf), templates_table(spark)))


def d4_drift_lines(spark, sf):
    return _long(detect_drift(_docs(spark, sf), templates_table(spark), sep="\n"))


def d4_drift_corpus(spark, sf):
    return _long(detect_drift(_corpus(spark, sf).select("doc_id", "text"), templates_table(spark)))


def d4_drift_empty_store(spark, sf):
    """Without any template every chunk is a low violation."""
    return _long(detect_drift(_docs(spark, sf), templates_table(spark).limit(0), sep="\n"))


# ------------------------------------------------------------------ audit (Q1) and around it

def m1_merge_violations(spark, sf):
    a = _audited(spark, sf)
    return _long(explode_rows(a, ["doc_id"], F.col("violations")).select(
        "doc_id", "v.seq", "v.scanner", "v.type", "v.pii_type", "v.rule_id", "v.severity",
        "v.span_start", "v.span_end", "v.chunk_index"))


def e1_policy_snippets(spark, sf):
    a = audit(_corpus(spark, sf).select("doc_id", "text"))
    return _long(explode_rows(a, ["doc_id"], F.col("violations")).where(F.col("v.rule_id").isNotNull())
                 .select("doc_id", "v.seq", "v.rule_id", "v.check_id", F.col("v.policy_snippet")
                         .alias("policy_snippet")))


def e2_similar_violations(spark, sf):
    hist = load_table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    a = audit(_docs(spark, sf), history=hist, keep_text=False, keep_suggestions=False)
    v = explode_rows(a, ["doc_id"], F.col("violations"))
    return _long(explode_rows(v, ["doc_id", F.col("v.seq").alias("seq")], F.col("v.similar_violations"), "pos", "s")
                 .select("doc_id", "seq", (F.col("pos") + 1).alias("rank"), F.col("s.id").alias("history_id"),
                         F.round("s.similarity", 6).alias("similarity")))


def w_suggestions(spark, sf):
    a = _audited(spark, sf)
    return _long(explode_rows(a, ["doc_id"], F.col("suggestions"), "seq", "s").select(
        "doc_id", "seq", "s.violation_id", "s.span_start", "s.span_end", "s.original_text",
        "s.replacement", "s.redaction_flag",
        F.array_join("s.explanation", " | ").alias("explanation"),
        F.array_join("s.citations", ",").alias("citations")))


def w_suggestions_corpus(spark, sf):
    a = audit(_corpus(spark, sf).select("doc_id", "text"))
    return _long(explode_rows(a, ["doc_id"], F.col("suggestions"), "seq", "s").select(
        "doc_id", "seq", "s.violation_id", "s.span_start", "s.span_end", "s.original_text",
        "s.replacement", "s.redaction_flag"))


def w3_template_context(spark, sf):
    from clausewise.operators.rewrite import template_context
    a = audit(_corpus(spark, sf).select("doc_id", "text"))
    out = template_context(a, templates_table(spark))
    return _long(out.select("doc_id", "seq", "template_id", F.round("similarity", 6).alias("similarity")))


def q1_audit(spark, sf):
    a = _audited(spark, sf)
    return _long(a.select("doc_id", "document_type", "violation_score", "n_critical", "n_high", "n_medium",
                          "n_low", "decision", "reason", "pii_found", "policy_found", "rules_checked",
                          "chunks_checked", "drift_found", "signatures_found", "signature_violations"))


def q1_audit_corpus(spark, sf):
    a = audit(_corpus(spark, sf).select("doc_id", "text"))
    return _long(a.select("doc_id", "document_type", "violation_score", "n_critical", "n_high", "n_medium",
                          "n_low", "decision", "reason", "pii_found", "policy_found", "rules_checked",
                          "chunks_checked", "drift_found", "signatures_found", "signature_violations"))


def _requested(spark, sf):
    """Requested ids; half of them name no document."""
    lab = load_table(spark, sf, "labels")
    return lab.select("doc_id").unionByName(lab.select((F.col("doc_id") + 1_000_000_000).alias("doc_id")))


def q1_audit_requested(spark, sf):
    """Requested ids, half of which name no document: those are error rows
    without a decision."""
    a = audit(_requested(spark, sf).join(_docs(spark, sf), "doc_id", "left"))
    return _long(a.select("doc_id", "status", "error", "decision", "reason", "violation_score"))


def f1_final_text(spark, sf):
    a = audit(_docs(spark, sf), keep_text=True)
    return final_text(a)


def f1_final_text_nodrift(spark, sf):
    """F1 with the template scanner switched off: documents whose only
    violation is one PII hit score 2 and are fixed automatically."""
    a = audit(_docs(spark, sf), keep_text=True, with_drift=False)
    return final_text(a)


def f1_all_fixes(spark, sf):
    """Every suggestion applied to every document, whatever the decision: whole-document
    edits, edits inside them and edits that overlap."""
    a = audit(_docs(spark, sf), keep_text=True)
    fixed = apply_fixes(F.col("text"), F.col("suggestions"))
    return a.where("text IS NOT NULL").select("doc_id", F.length(fixed).cast("bigint").alias("n_chars"), F.sha2(fixed, 256).alias("digest"))


def f2_change_segments(spark, sf):
    a = audit(_corpus(spark, sf).select("doc_id", "text"))
    return _long(change_segments(a))


def o1_audit_counters(spark, sf):
    return audit_counters(_audited(spark, sf))


def o2_duration_histogram(spark, sf):
    return duration_histogram(load_table(spark, sf, "events"), "value")


def k1_review_queue(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "text", "source")
    a = audit(docs, carry=("source",))
    t = review_queue(a, RUN_ID, department_col="source")
    return t.select("ticket_id", "document_id", "processing_id", "status", "violation_summary", "severity",
                    "department")


def event_status(event_type):
    """Status carried by an update event (our mapping of event types)."""
    return (F.when(event_type == "view", "in_review").when(event_type == "click", "assigned")
            .when(event_type == "purchase", "resolved").when(event_type == "error", "reopened")
            .otherwise("open"))


def _ticket_updates(spark, sf, tickets):
    """Status updates from `events`: the event's user id names the document
    whose ticket it updates; the event type maps to a status."""
    ev = load_table(spark, sf, "events")
    status = event_status(F.col("event_type"))
    return ev.select("event_id", "ts", F.substring(F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("|"),
                                                                       F.lit(RUN_ID)), 256), 1, 32)
                     .alias("ticket_id"), status.alias("status"))


def k3_ticket_status(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "text", "source")
    a = audit(docs, carry=("source",))
    t = review_queue(a, RUN_ID, department_col="source")
    current, _rejected = update_ticket_status(t, _ticket_updates(spark, sf, t))
    return current.select("ticket_id", "document_id", "status", "n_updates")


def k3_rejected_updates(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "text", "source")
    a = audit(docs, carry=("source",))
    t = review_queue(a, RUN_ID, department_col="source")
    _current, rejected = update_ticket_status(t, _ticket_updates(spark, sf, t))
    return rejected.groupBy("status").agg(F.sum("n_updates").cast("bigint").alias("n_rejected"))


def k2_open_tickets(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "text", "source")
    a = audit(docs, carry=("source",))
    t = review_queue(a, RUN_ID, department_col="source")
    current, _rejected = update_ticket_status(t, _ticket_updates(spark, sf, t))
    return list_tickets(current, status="open").select("ticket_id", "document_id", "status", "n_updates")


def s11_write_audit(spark, sf):
    """Write the audit tables to the shared folder, then read them back."""
    import os
    import uuid
    from clausewise.session import checkpoint_dir
    out = os.path.join(checkpoint_dir(spark), f"audit-tables-{uuid.uuid4().hex}")
    paths = ingest.write_audit(audit(_docs(spark, sf)), out, RUN_ID)
    res = spark.read.parquet(paths["audit_results"])
    nv = spark.read.parquet(paths["audit_violations"]).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_violation_rows"))
    return _long(res.join(nv, "doc_id", "left").select(
        "doc_id", "run_id", "decision", "violation_score",
        F.coalesce("n_violation_rows", F.lit(0)).alias("n_violation_rows")))


def v1_evaluate_pii(spark, sf):
    """Labels and detections of a document live in the same row: narrow
    per-document counts, then one global aggregate (no shuffle)."""
    from clausewise.operators.evaluate import evaluate_pii_rows
    from clausewise.operators.pii import pii_violations_of
    c = _corpus(spark, sf)
    gt = F.transform(F.coalesce("label.pii_spans", F.array().cast(
        "array<struct<span_start:int,span_end:int,pii_type:string,text:string>>")), lambda s: s["text"])
    det = F.transform(pii_violations_of(c, "text"), lambda v: v["text"])
    return evaluate_pii_rows(c.select(gt.alias("gt"), det.alias("det")))


def v1_evaluate_audit(spark, sf):
    """The join form: the audit's personal data against the corpus labels, by document id."""
    c = _corpus(spark, sf)
    found = explode_rows(audit(c.select("doc_id", "text")), ["doc_id"], F.col("violations")).where(F.col("v.type") == "pii")
    truth = c.select("doc_id", F.transform("label.pii_spans", lambda g: g["text"]).alias("gt"))
    return evaluate_pii(detection_counts(found.select("doc_id", F.col("v.text").alias("text"))), truth)


# ------------------------------------------------------------------ sources

def s2_labels_join(spark, sf):
    lab = load_table(spark, sf, "labels")
    return _long(ingest.with_labels(_docs(spark, sf).select("doc_id", F.length("text").alias("n_chars")), lab))


def s4_route_file_type(spark, sf):
    return ingest.route_files(load_table(spark, sf, "pages"), "url", "page_id")


def s4_route_files_orders(spark, sf):
    """File names with every suffix, some with `#` and `?`, from `orders`."""
    names = [".pdf", ".DOCX", ".doc", " #2.png", ".txt", ".zip", "", "?.jpeg", ".tar.GIF", ".bmp"]
    k = F.col("o_orderkey")
    name = F.concat(F.lit("inbox/file "), k.cast("string"), F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int")))
    return ingest.route_files(load_table(spark, sf, "orders").select(k, name.alias("path")), "path", "o_orderkey")


def s12_error_rows_requested(spark, sf):
    return ingest.error_rows(_requested(spark, sf).join(_docs(spark, sf), "doc_id", "left"))


def s5_extract_blocks(spark, sf):
    c = load_table(spark, sf, "conversations")
    return _long(ingest.extract_blocks(c.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text"),
                                       sep="\n"))


def s6_ocr_blocks(spark, sf):
    """OCR results derived from `conversations`: a line per turn, its
    confidence and box computed from the keys."""
    c = load_table(spark, sf, "conversations")
    x, y = F.col("turn").cast("double"), (F.col("turn") + 1).cast("double")
    ocr = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text",
                   (((F.col("conv_id") * 7 + F.col("turn") * 13) % 10) / F.lit(10.0)).alias("confidence"),
                   F.array(F.array(x, x), F.array(y, x), F.array(y, y), F.array(x, y)).alias("bbox"))
    return ingest.ocr_blocks(ocr).select("doc_id", "block_id", "text", F.col("bbox.x1").alias("x1"), F.col("bbox.y2").alias("y2"))


def s7_assemble_documents(spark, sf):
    c = load_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text",
        F.when(F.col("role") == "system", "header").otherwise("paragraph").alias("block_type"))
    out = ingest.assemble_documents(c)
    return _long(out.select("doc_id", "full_text", "total_pages", F.array_join("headers", " | ").alias("headers"),
                            "n_blocks"))


def s8_heading_tagging(spark, sf):
    return ingest.html_paragraphs(load_table(spark, sf, "pages")).groupBy("page_id", "block_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_blocks"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


def s9_pseudonymise(spark, sf):
    c = load_table(spark, sf, "customer")
    return ingest.pseudonymise(c, "c_name", "c_mktsegment", "c_custkey")


def s10_upsert_vectors(spark, sf):
    e = load_table(spark, sf, "embeddings")
    # each row is an add event for key `label`, in vec_id order: last write wins
    recs = e.select(F.col("label").alias("id"), F.col("vec_id").alias("stored_at"), "embedding")
    out = upsert_vectors(recs, "id", ("stored_at",))
    return _long(out.select("id", F.col("stored_at").alias("vec_id"),
                            F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_embedding")))


def s12_error_rows(spark, sf):
    return ingest.error_rows(_docs(spark, sf))


def s13_generate_corpus(spark, sf):
    c = _corpus(spark, sf)
    return _long(c.select("doc_id", "doc_name", "document_type", "variant", "text",
                          F.size(F.coalesce("label.pii_spans", F.array())).alias("n_pii_labels"),
                          F.size("label.violations").alias("n_violation_labels")))


def q2_audit_lookup(spark, sf):
    """Only requested documents are audited."""
    req = _requested(spark, sf)
    a = audit(_docs(spark, sf).join(req.distinct(), "doc_id", "left_semi"))
    return _long(ingest.audit_lookup(a.select("doc_id", "decision", "violation_score"), req))


def q3_audit_stream(spark, sf):
    from clausewise.streaming.audit_stream import run_audit_stream
    return run_audit_stream(spark, sf)


def q4_stream_metrics(spark, sf):
    from clausewise.streaming.metrics_stream import run_event_metrics
    m = run_event_metrics(spark, sf)
    return m.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"),
                    F.date_format("window_end", "yyyy-MM-dd").alias("window_end"), "event_type", "n_events",
                    F.round("total_value", 6).alias("total_value"))


def q4_severity_stream(spark, sf):
    from clausewise.streaming.metrics_stream import severity_counts_stream_run
    return severity_counts_stream_run(spark, sf)


def k3_ticket_status_stream(spark, sf):
    from clausewise.streaming.metrics_stream import ticket_status_stream_run
    return ticket_status_stream_run(spark, sf, RUN_ID, event_status)


def q3_audit_stream_history(spark, sf):
    """Documents as a stream by micro-batches, against conversations as templates
    (by the blocked search) and the benchmark texts as violation history."""
    from clausewise.streaming.audit_stream import run_audit_batches
    talk = load_table(spark, sf, "conversations").where("text IS NOT NULL")
    templates = talk.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("template_id"), "text")
    history = load_table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")

    def rows(audited):
        v = explode_rows(audited, ["doc_id", "decision", "violation_score", "drift_found"], F.col("violations"))
        keep = ["doc_id", "decision", "violation_score", "drift_found", F.col("v.seq").alias("seq"), F.col("v.severity").alias("severity")]
        return _long(explode_rows(v, keep, F.col("v.similar_violations"), "pos", "s").select(
            *[k if isinstance(k, str) else F.col(n) for k, n in zip(keep, ["doc_id", "decision", "violation_score", "drift_found", "seq", "severity"])],
            (F.col("pos") + 1).alias("rank"), F.col("s.id").alias("history_id"), F.round("s.similarity", 6).alias("similarity")))
    return run_audit_batches(spark, sf, templates, history, rows, broadcast_bytes=0, keep_text=False, keep_suggestions=False)


def _stored(spark, name, **kw):
    import uuid
    from clausewise.session import checkpoint_dir
    from clausewise.sources.vector_table import VectorTable
    return VectorTable(spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", **kw)


def s10_vector_table(spark, sf):
    """Embeddings keyed by label in three writes with a compaction between, then reloaded."""
    from clausewise.sources.vector_table import VectorTable, records_of
    e = load_table(spark, sf, "embeddings")
    table = _stored(spark, "vectors", buckets=8)
    for version in range(3):
        part = e.where(F.col("vec_id") % 3 == version)
        table.upsert(records_of(part, "label", None, "embedding", stored_at=F.timestamp_seconds("vec_id"), metadata=F.col("vec_id")))
        if version == 1:
            table.compact()
    out = VectorTable(spark, table.path, buckets=8).read()
    return out.select("id", F.col("metadata").cast("bigint").alias("vec_id"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_embedding"))


def s10_violation_history(spark, sf):
    """An audit's violations stored as history (twice: the run counts once), reloaded."""
    from clausewise.sources.vector_table import violation_records
    table = _stored(spark, "history", buckets=8)
    found = written(violation_records(_audited(spark, sf), RUN_ID, stored_at=F.timestamp_seconds(F.lit(0))), "violation-records")
    for _ in range(2):
        table.upsert(found, version=0)
    told = lambda name: F.get_json_object("metadata", f"$.{name}").alias(name)
    return table.read().groupBy(told("type"), told("severity")).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("text").alias("n_texts"))


def d4_drift_vectors(spark, sf):
    """Drift on supplied vectors: documents of four vectors each, every 25th vector as a template."""
    from clausewise.operators.drift import drift_of_vectors
    e = load_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    packed = e.groupBy(F.floor(F.col("vec_id") / 4).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("x"))
    chunk = lambda x: F.struct(F.pmod(x["vec_id"], F.lit(4)).cast("int").alias("chunk_index"), F.lit("").alias("chunk"),
                               F.lit(0).alias("span_start"), F.lit(0).alias("span_end"))
    docs = packed.select("doc_id", F.transform("x", chunk).alias("chunks"), F.transform("x", lambda x: x["v"]).alias("vectors"))
    templates = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("template_id"), F.col("v").alias("embedding"))
    return _long(drift_of_vectors(docs, templates).select("doc_id", "chunk_index", "similarity", "severity"))


def _uploads(spark, sf, table, name, keep):
    """A folder per upload, named like the file, with the text inside."""
    import uuid
    from clausewise.session import checkpoint_dir
    folder = f"{checkpoint_dir(spark)}/uploads-{uuid.uuid4().hex}"
    rows = dealt(load_table(spark, sf, table).where(F.col("text").isNotNull() & keep).select(F.col("text").alias("value"), name.alias("name")), UPLOADS_PER_TASK, by="name")  # rows of one name: one file
    return folder, rows


def _upload_name():
    k = F.col("doc_id")
    return F.concat(F.lit("doc"), k.cast("string"), F.when(k % 10 == 7, ".zip").when(k % 10 == 8, "").when(k % 2 == 0, ".TXT").otherwise(".txt"))


def _write_uploads(rows, folder):
    # each task moves its own files into place: the other committer has the driver move them, one folder after another
    out = rows.write.mode("append").options(**ingest.PLAIN_FILES).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    out.partitionBy("name").option("lineSep", "\n").text(folder)


def s1_read_corpus(spark, sf):
    """Documents written as text files, read back whole: id = file stem."""
    folder, rows = _uploads(spark, sf, "documents", _upload_name(), F.lit(True))
    _write_uploads(rows, folder)
    back = ingest.read_uploads(spark, folder, "folder").withColumn("name", F.regexp_replace("name", "^name=", ""))
    back = back.where(ingest.route_file_type(F.col("name")) == "text")
    text = F.regexp_replace("text", r"\n\z", "")  # the writer's line end
    return back.select(ingest._stem(F.col("name")).alias("doc_id"), F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("digest"))


def s3_reference_texts(spark, sf):
    """Benchmark texts written as policy files, read back: id = file stem, other suffixes left out."""
    from clausewise.sources.reference_texts import reference_rows
    i = F.col("item_id")
    suffix = F.when(i % 4 == 0, ".txt").when(i % 4 == 1, ".md").when(i % 4 == 2, ".mdx").otherwise(".md.txt")
    folder, rows = _uploads(spark, sf, "benchmark", F.concat(F.lit("notes.v"), i.cast("string"), suffix), F.lit(True))
    _write_uploads(rows, folder)
    back = ingest.read_uploads(spark, folder, "folder").select(F.regexp_replace("name", "^name=", "").alias("name"), F.regexp_replace("text", r"\n\z", "").alias("text"))
    return reference_rows(back).select("id", F.sha2("text", 256).alias("digest"))


def q1_audit_files(spark, sf):
    """From files to audit rows in two runs: the second takes the files that came since."""
    import uuid
    from clausewise.plans.intake import audit_files
    from clausewise.session import checkpoint_dir
    out = f"{checkpoint_dir(spark)}/intake-{uuid.uuid4().hex}"
    folder, rows = _uploads(spark, sf, "documents", _upload_name(), F.lit(True))
    k = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    about = rows.select(F.concat(F.lit("name="), "name").alias("name"), F.concat(F.lit("user"), (k % 5).cast("string")).alias("uploader"),
                        F.when(k % 4 != 0, F.concat(F.lit("dep"), (k % 4).cast("string"))).alias("department"))
    runs = []
    for run_id, part in (("run-1", k % 3 == 0), ("run-2", k % 3 != 0)):
        _write_uploads(rows.where(part), folder)
        runs.append(audit_files(spark, folder, out, run_id, metadata=about, name_from="folder"))
    bare = lambda c: F.regexp_replace(c, "^name=", "").alias(c)
    return _long(runs[0].unionByName(runs[1]).select(bare("name"), bare("doc_id"), "run_id", "status", "error", "decision", "violation_score", "n_blocks",
                                                     "uploader_id", "department"))


QUERIES = {
    name: fn for name, fn in dict(globals()).items()
    if callable(fn) and name[:2] in {"t1", "p1", "p3", "p4", "r1", "r7", "g1", "g3", "d1", "d2", "d3", "d4",
                                     "m1", "e1", "e2", "w_", "w3", "q1", "q2", "q3", "q4", "f1", "f2", "o1", "o2",
                                     "k1", "k2", "k3", "v1", "s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8", "s9", "s1"}
    and getattr(fn, "__module__", "") == __name__
}
