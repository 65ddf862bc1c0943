"""Reading, parsing-result shaping, pseudonymising, sinks.

File decoders (PDF, DOCX, OCR engines) are per-file libraries and are not
part of this package; these operators take their outputs as tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.functions.text import explode_rows, py_strip, split_paragraphs
from clausewise.session import setting

# Fixed values (must equal the reference's file routing).
FILE_TYPES = [
    ("pdf", [".pdf"]),
    ("docx", [".docx", ".doc"]),
    ("image", [".png", ".jpg", ".jpeg", ".gif", ".bmp"]),
]
TEXT_SUFFIXES = [".txt"]          # our addition: plain text is read as is
OCR_MIN_CONFIDENCE = 0.5          # keep strictly greater
MAX_HEADERS = 5
HEADING_STYLE_PREFIX = "Heading"
BLOCK_SEP = "\n\n"
NO_UPLOADER, NO_DEPARTMENT = "anonymous", "unknown"
READ_FILES, READ_BYTES = 500, 64_000_000   # of small files that one task reads
#: Writes to local folders without a checksum file (and a process, chmod, that Hadoop starts to make it) beside each file.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 16                         # of a core, at most

LABEL_JSON_SCHEMA = T.StructType([
    T.StructField("document_type", T.StringType()),
    T.StructField("pii_spans", T.ArrayType(T.StructType([
        T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()),
        T.StructField("pii_type", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("violations", T.ArrayType(T.StructType([
        T.StructField("rule_id", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType())]))),
])


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def read_corpus(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """Each text file is one document, id = file stem."""
    df = spark.read.text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return (df.select(F.col("value").alias("text"), name.alias("_name"))
            .where(F.col("_name").endswith(suffix))
            .select(_stem(F.col("_name")).alias("doc_id"), "text"))


def read_uploads(spark: SparkSession, path: str, name_from: str = "file") -> DataFrame:
    """Uploaded files as rows: path, name, modified, text (whole).  The name is
    the file's, or that of its folder where each upload has one (`name_from="folder"`)."""
    # a folder per upload: left alone, Spark lists them with a task each, up to the setting (10,000)
    with setting(spark, LISTING, min(int(spark.conf.get(LISTING, "10000")), LISTING_TASKS * spark.sparkContext.defaultParallelism)):
        df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    full = F.col("_metadata.file_path")
    last = F.element_at(F.split(F.url_decode(F.regexp_replace(full, r"\+", "%2B")), "/"), -1 if name_from == "file" else -2)
    rows = df.select(full.alias("path"), last.alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return rows.coalesce(read_tasks(df))


def read_tasks(files: DataFrame) -> int:
    """Tasks that read small files: a file counts as 4 MB (`spark.sql.files.openCostInBytes`) when Spark
    packs them, so that a task would read a handful and most of the time go into tasks."""
    n_files = len(files._jdf.inputFiles())   # of the driver's listing
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(math.ceil(n_files / READ_FILES), math.ceil(size / READ_BYTES), files.sparkSession.sparkContext.defaultParallelism)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON sidecars (one object per file), id = file stem."""
    df = spark.read.schema(LABEL_JSON_SCHEMA).option("multiLine", True).json(path)
    return df.select(_stem(F.col("_metadata.file_name")).alias("doc_id"), "*")


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """S2 join: every document keeps its row; `has_label` tells coverage."""
    lab = labels.withColumn("_has_label", F.lit(True))
    return (docs.join(lab, id_col, "left")
            .withColumn("has_label", F.coalesce("_has_label", F.lit(False))).drop("_has_label"))


def file_suffix(path: Column) -> Column:
    """Lower-cased suffix of the last path component ('' if none), like a
    path library's `suffix`.  Query and fragment are cut from URLs only: `#`
    and `?` are ordinary characters of file names."""
    url = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    p = F.when(path.rlike(url), F.regexp_replace(F.regexp_replace(path, r"(?s)[?#].*$", ""), url + "[^/]*", "")).otherwise(path)
    last = F.regexp_extract(p, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"^.+(\.[^.]+)$", 1))


def route_file_type(path: Column) -> Column:
    """Pdf / docx / image / text / unsupported."""
    sfx = file_suffix(path)
    out = F.when(sfx.isin(TEXT_SUFFIXES), F.lit("text")).otherwise(F.lit("unsupported"))
    for name, suffixes in reversed(FILE_TYPES):
        out = F.when(sfx.isin(suffixes), F.lit(name)).otherwise(out)
    return out


def route_files(files: DataFrame, path_col: str, id_col: str) -> DataFrame:
    """S4 + S12: route each file; unsupported ones become error rows."""
    sfx = file_suffix(F.col(path_col))
    ft = route_file_type(F.col(path_col))
    return files.select(
        F.col(id_col), sfx.alias("suffix"), ft.alias("file_type"),
        F.when(ft == "unsupported", F.lit("error")).otherwise(F.lit("accepted")).alias("status"),
        F.when(ft == "unsupported", F.concat(F.lit("Unsupported file type: "), sfx)).alias("error"))


def error_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that cannot be audited get status 'error' and a reason;
    the rest 'ok'.  Nothing is dropped."""
    err = text_error(F.col(text_col))
    return docs.select(F.col(id_col), F.when(err.isNull(), F.lit("ok")).otherwise(F.lit("error"))
                       .alias("status"), err.alias("error"))


def text_error(t: Column) -> Column:
    """Why a text cannot be audited; NULL if it can."""
    return (F.when(t.isNull(), F.lit("document text is missing"))
            .when(F.length(py_strip(t)) == 0, F.lit("document text is empty")))


def extract_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: Column | None = None,
                   sep: str = BLOCK_SEP) -> DataFrame:
    """Paragraph blocks of a page text: split, strip, drop empty,
    numbered after dropping; block_id = page_{p}_block_{i}."""
    pg = page if page is not None else F.lit(1)
    return (explode_rows(docs, [F.col(id_col), pg.alias("page")], split_paragraphs(F.col(text_col), sep),
                         "idx", "text")
            .select(id_col, F.col("page").cast("int").alias("page"),
                    F.format_string("page_%d_block_%d", F.col("page"), F.col("idx")).alias("block_id"),
                    "text", F.lit("paragraph").alias("block_type")))


def ocr_blocks(ocr: DataFrame) -> DataFrame:
    """OCR results (doc_id, idx, text, confidence, bbox = 4 corner points)
    -> blocks with confidence > 0.5 and bbox from corners 0 and 2."""
    b = F.col("bbox")
    return ocr.where(F.col("confidence") > OCR_MIN_CONFIDENCE).select(
        "doc_id", F.lit(1).alias("page"), F.format_string("ocr_block_%d", F.col("idx")).alias("block_id"),
        "text",
        F.struct(F.get(F.get(b, 0), 0).alias("x1"), F.get(F.get(b, 0), 1).alias("y1"),
                 F.get(F.get(b, 2), 0).alias("x2"), F.get(F.get(b, 2), 1).alias("y2")).alias("bbox"),
        F.lit("paragraph").alias("block_type"))


def heading_type(style: Column) -> Column:
    """Header when the paragraph style name starts with 'Heading'."""
    return F.when(F.coalesce(style, F.lit("")).startswith(HEADING_STYLE_PREFIX), F.lit("header")) \
        .otherwise(F.lit("paragraph"))


# A paragraph runs from its start tag to the next paragraph or heading start,
# to any closing paragraph, heading or container tag, or to the end.
HTML_OPEN = r"<(?:h[1-6]|p)(?:\s[^>]*)?>"
HTML_CLOSE = r"</(?:h[1-6]|p|article|section|div|main|header|footer|aside|nav|td|li|ul|ol|table|form|body|html)\s*>"
HTML_BLOCK = rf"(?is)<(h[1-6]|p)(?:\s[^>]*)?>(.*?)(?={HTML_OPEN}|{HTML_CLOSE}|\z)"
HTML_SKIPPED = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->"


def html_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S8 over raw pages: each <h1>..<h6> or <p> element, in any letter case,
    becomes a paragraph whose style is 'Heading N' or 'Normal'; its whole text
    (inner tags taken out), stripped, empty ones dropped."""
    src = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), HTML_SKIPPED, "")
    tags = F.regexp_extract_all(src, F.lit(HTML_BLOCK), 1)
    texts = F.regexp_extract_all(src, F.lit(HTML_BLOCK), 2)
    z = F.arrays_zip(tags.alias("tag"), texts.alias("text"))
    bare = py_strip(F.regexp_replace(F.col("z.text"), r"<[^>]*>", ""))
    paras = (explode_rows(pages, [F.col(id_col)], z, val="z")
             .select(id_col, F.lower("z.tag").alias("tag"), bare.alias("text"))
             .where(F.length("text") > 0))
    style = F.when(F.col("tag").startswith("h"),
                   F.concat(F.lit("Heading "), F.substring(F.col("tag"), 2, 1))).otherwise(F.lit("Normal"))
    return paras.select(id_col, "text", style.alias("style"), heading_type(style).alias("block_type"))


def assemble_documents(blocks: DataFrame, id_col: str = "doc_id", pos_col: str = "pos",
                       page_col: str | None = None, type_col: str = "block_type",
                       sep: str = BLOCK_SEP, run: int = 1024, max_headers: int = MAX_HEADERS) -> DataFrame:
    """Blocks -> (id, full_text, total_pages, headers, n_blocks).

    Two-level, so a document with very many blocks is not collected by one
    task in one go: blocks are first concatenated per run of `run`
    consecutive positions (partial aggregation spread over tasks), then the
    runs are joined in order.  The output row necessarily holds the whole
    document text."""
    pg = F.col(page_col) if page_col else F.lit(1)
    b = blocks.select(F.col(id_col), F.col(pos_col).alias("_pos"), F.col("text"), pg.alias("_page"),
                      F.col(type_col).alias("_type"))
    runs = b.groupBy(id_col, F.floor(F.col("_pos") / run).alias("_run")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "text"))).alias("_items"),
        F.max("_page").alias("_maxpage"),
        F.count(F.lit(1)).alias("_n"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("_type") == "header", F.struct("_pos", "text")))),
                1, max_headers).alias("_heads"))
    part = runs.select(id_col, "_run", F.array_join(F.transform("_items", lambda x: x["text"]), sep).alias("_txt"),
                       "_maxpage", "_n", "_heads")
    docs = part.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("_run", "_txt"))).alias("_parts"),
        F.max("_maxpage").alias("total_pages"), F.sum("_n").alias("n_blocks"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_run", "_heads"))),
                              lambda x: x["_heads"])).alias("_h"))
    return docs.select(
        id_col, F.array_join(F.transform("_parts", lambda x: x["_txt"]), sep).alias("full_text"),
        F.coalesce(F.col("total_pages"), F.lit(1)).cast("int").alias("total_pages"),
        F.transform(F.slice("_h", 1, max_headers), lambda x: x["text"]).alias("headers"),
        F.col("n_blocks").cast("bigint").alias("n_blocks"))


def pseudonymise(uploads: DataFrame, uploader_col: str | None, department_col: str | None,
                 id_col: str | None = None, hash_ids: bool = True) -> DataFrame:
    """Uploader -> sha256[:16] (switchable), defaults 'anonymous' and
    'unknown'; processing id = given id or a random uuid."""
    up = F.coalesce(F.col(uploader_col), F.lit(NO_UPLOADER)) if uploader_col else F.lit(NO_UPLOADER)
    dep = F.coalesce(F.col(department_col), F.lit(NO_DEPARTMENT)) if department_col else F.lit(NO_DEPARTMENT)
    pid = F.coalesce(F.col(id_col).cast("string"), F.expr("uuid()")) if id_col else F.expr("uuid()")
    return uploads.select(pid.alias("processing_id"),
                          (F.substring(F.sha2(up, 256), 1, 16) if hash_ids else up).alias("uploader_id"),
                          dep.alias("department"))


def write_audit(audits: DataFrame, out_dir: str, run_id: str, mask_pii_text: bool = False) -> dict:
    """Audit tables partitioned by run id.  Writing replaces only this
    run's partition (dynamic overwrite), so re-running a failed run is
    idempotent; task retries are covered by the file commit protocol.

    The audit is computed once and written whole (`audit_full`); the derived
    tables are then read from that written copy, so the expensive per-document
    work is not repeated per table and lineage is cut at a table in the
    shared folder.  Returns the table paths."""
    from clausewise.operators.pii import redact
    from clausewise.operators.rewrite import apply_fixes
    spark = audits.sparkSession
    a = audits.withColumn("run_id", F.lit(run_id))
    id_col = audits.columns[0]
    if "text" in audits.columns:
        a = a.withColumn("_final", F.when(F.col("decision") == "Auto-Fix", apply_fixes(F.col("text"), F.col("suggestions"))))
    if mask_pii_text:
        # the clear value stands in the text, in the violations and in the suggestions' originals
        if "text" in audits.columns:
            a = a.withColumn("text", redact(F.col("text"), F.filter("violations", lambda v: v["type"] == "pii")))
        a = a.withColumn("suggestions", F.transform("suggestions", lambda s: s.withField("original_text", F.when(
            F.coalesce(s["redaction_flag"], F.lit(False)), F.sha2(s["original_text"], 256)))))
        a = a.withColumn("violations", F.transform("violations", lambda v: v.withField(
            "text", F.when(v["type"] == "pii", F.sha2(v["text"], 256)).otherwise(v["text"]))))
    paths = {k: f"{out_dir}/{k}" for k in ("audit_full", "audit_results", "audit_violations",
                                            "audit_suggestions", "audit_final_text")}
    def write_run(df: DataFrame, path: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id").parquet(path))

    write_run(a, paths["audit_full"])
    full = spark.read.schema(a.schema).parquet(paths["audit_full"]).where(F.col("run_id") == run_id)
    # clustered by id: a look-up reads the few row groups whose range holds its ids
    results = full.drop("violations", "suggestions", "text", "_final")
    write_run(results.repartitionByRange(id_col).sortWithinPartitions(id_col), paths["audit_results"])
    write_run(explode_rows(full, ["run_id", id_col], F.col("violations"))
              .select("run_id", id_col, "v.*").drop("similar_violations"), paths["audit_violations"])
    write_run(explode_rows(full, ["run_id", id_col], F.col("suggestions"), "seq", "s")
              .select("run_id", id_col, "seq", "s.*"), paths["audit_suggestions"])
    if "_final" in full.columns:
        write_run(full.where(F.col("decision") == "Auto-Fix").select("run_id", id_col, F.col("_final").alias("final_text")),
                  paths["audit_final_text"])
    return paths


def audit_lookup(results: DataFrame, requested: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Q2: status of requested ids; ids never audited come back 'not_found'."""
    r = results.withColumn("_found", F.lit(True))
    return (requested.select(id_col).join(r, id_col, "left")
            .withColumn("status", F.when(F.col("_found"), F.lit("completed")).otherwise(F.lit("not_found")))
            .drop("_found"))


#: Id lists up to this length become a literal filter; longer ones a join.
LITERAL_LOOKUP_IDS = 10_000


def audit_status(spark: SparkSession, results_path: str, ids: list, id_col: str = "doc_id") -> DataFrame:
    """Q2 for given ids against the stored audit table: a short id list is a
    literal `IN` filter, pushed to the parquet scan (row-group statistics skip
    the rest); any list is then joined, and ids never audited come back
    'not_found'."""
    res = spark.read.parquet(results_path)
    if len(ids) <= LITERAL_LOOKUP_IDS:
        res = res.where(F.col(id_col).isin(list(ids)))
    req = spark.createDataFrame([(i,) for i in ids], T.StructType([res.schema[id_col]]))
    return audit_lookup(res, req, id_col)

