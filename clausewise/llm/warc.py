"""Operator 9: WARC archives, written and read back by boundary-chain verification.

Writing: one record per row.  Of records with equal payloads of at least
`min_bytes`, that with the largest id is the response, others are revisits that
name it and carry no payload; shorter payloads are all responses.  Records go
out through Spark's text writer, one archive per task, so any shared store will do.
A record ends with CR LF CR LF, whose last byte is the writer's line end.

Reading: archives are split anywhere.  Spark's text reader cuts them at the
record magic, so each piece is one candidate record or a part of a payload that
holds the magic.  Tasks emit each candidate's offset and its successor's (header
and Content-Length); pointer jumping from the file starts (doubling, one join a
round, narrow rows) keeps the candidates on the chain.  A record whose payload
holds the magic spans several pieces; only those pieces are read once more, found by file,
length and content hash (however the second read is split), and put together.  A chain that does not end at the end of its file raises an error row
(`broken`), which the reader reports rather than hides.

All of it is DataFrame work; payloads are never shuffled except those of
records that span pieces (and, beyond the broadcast threshold of the digests that
occur more than once, the rows to write).

Edge cases: a null payload is empty; null ids are written as an empty id and
read back as null, and count as the smallest id; rows that repeat the largest id of
a payload are all responses; an empty table gives no archive and no rows; other columns are ignored; CR or LF in a URL are written as blanks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.llm.common import materialise, table
from clausewise.session import checkpoint_dir

MAGIC = "WARC/1.0\r\n"
HEX_PER_GROUP, BASE32_PER_GROUP = 5, 4


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 (40 hex digits: 8 groups of 20 bits)."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + HEX_PER_GROUP * i, HEX_PER_GROUP), 16, 32), BASE32_PER_GROUP, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write the archives of a table into the folder `path`."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digested = rows.select("page_id", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload").cast("binary")).alias("digest"))
    # payloads that occur more than once: who is the response
    several = digested.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    several = materialise(several, "warc-several")  # its size is known: the planner broadcasts it only if small
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("_key", F.when(F.col("n_bytes") >= min_bytes, F.col("digest")))
    rows = rows.join(several.select(F.col("digest").alias("_key"), "keeper"), "_key", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.translate(F.coalesce(F.col("url"), F.lit("")), "\r\n", "  "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("n_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    rows.select(F.concat(head, body, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, row, value: the text between magics, in file order inside a split."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("row"), "value"))


def _field(head: Column, name: str) -> Column:
    got = F.regexp_extract(head, rf"(?:^|\r\n){name}: ?([^\r\n]*)", 1)
    return F.when(got != "", got)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row per piece: file, offset of its magic, end of the piece,
    header fields, successor offset, digest of the payload if the piece holds it."""
    gap = len(MAGIC)
    value = F.col("value")
    cut = F.instr(value, "\r\n\r\n")
    head = F.when(cut > 0, F.substring(value, F.lit(1), cut - 1))
    p = _pieces(spark, path).withColumn("head", head)
    p = p.withColumn("head_bytes", F.octet_length("head").cast("long") + 4).withColumn("bytes", F.octet_length("value").cast("long"))
    p = p.withColumn("length", F.when(F.col("head").startswith("WARC-Type: "), _field(F.col("head"), "Content-Length").try_cast("long")))
    whole = F.col("bytes") >= F.col("head_bytes") + F.col("length")
    payload = F.substring(value.cast("binary"), (F.col("head_bytes") + 1).cast("int"), F.col("length").cast("int"))
    p = p.select(
        "file", "split", "row", "bytes", F.xxhash64("value").alias("content"), "head_bytes", "length", F.when(whole, base32_sha1(payload)).alias("body_digest"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        F.regexp_extract("head", r"WARC-Record-ID: <urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract("head", r"WARC-Refers-To: <urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("stated"),
        _field(F.col("head"), "X-Payload-Length").try_cast("long").alias("stated_bytes"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"))
    p = materialise(p, "warc-pieces")
    # offsets: a running sum inside each split, after the totals of the splits before it
    # (a row of a split: its text and the magic that ends it; the end of the file has none)
    step = F.col("bytes") + gap
    totals = p.groupBy("file", "split").agg(F.sum(step).alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("rel", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    p = p.join(totals.select("file", "split", "base"), ["file", "split"])
    at = F.col("base") + F.col("rel") - gap  # of the magic before the piece; the empty piece at a file's start is at -gap
    p = p.withColumn("offset", at).withColumn("end", F.col("offset") + gap + F.col("bytes"))
    return p.withColumn("next", F.col("offset") + gap + F.col("head_bytes") + F.col("length") + 4).drop("rel", "base")


def on_chain(found: DataFrame) -> DataFrame:
    """(file, offset) of the candidates reachable from offset 0 of their file.

    Pointer jumping: after round i the reached set holds the first 2^i records
    of each chain, and `next` jumps 2^i records."""
    links = found.filter("offset >= 0 AND next IS NOT NULL").select("file", "offset", "next")
    jump = materialise(links, "warc-jump")
    reached = materialise(links.filter("offset = 0").select("file", "offset"), "warc-reached")
    n = reached.count()
    while n:
        hop = reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        grown = materialise(reached.unionByName(hop).distinct(), "warc-reached")
        m = grown.count()
        reached = grown
        if m == n:
            break
        n = m
        jump = materialise(jump.alias("a").join(jump.alias("b"), F.expr("a.file = b.file AND a.next = b.offset"))
                           .select("a.file", "a.offset", F.col("b.next").alias("next")), "warc-jump")
    # the jump past the last record names the end of the file, which holds no candidate
    return reached.join(links.select("file", "offset"), ["file", "offset"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (of the full payload; stated by revisits), body_bytes, sound
    (the payload read has the stated digest), broken (the chain stops here
    before the end of the file)."""
    found = candidates(spark, path)
    found = materialise(found, "warc-candidates")
    chain = materialise(on_chain(found), "warc-chain")
    records = found.join(chain, ["file", "offset"])
    ends = found.groupBy("file").agg(F.max("end").alias("file_end"))
    # records that go on over further pieces: their payloads hold the magic
    spanning = records.filter("body_digest IS NULL").select("file", F.col("offset").alias("start"), "next", "head_bytes", "length")
    spanning = materialise(spanning, "warc-spanning")
    records = records.select("file", "offset", "next", "page_id", "url", "record_type", "refers_to", "stated", "stated_bytes",
                             "length", "body_digest")
    if spanning.count():
        part = found.alias("f").join(spanning.alias("s"), F.expr("f.file = s.file AND f.offset >= s.start AND f.offset < s.next")).select(
            "f.file", "f.offset", "f.bytes", "f.content", "s.start", "s.head_bytes", "s.length")
        part = materialise(part, "warc-parts")
        # equal pieces of one file are interchangeable: one of each is kept
        key = ["file", "bytes", "content"]
        again = _pieces(spark, path).select("file", F.octet_length("value").cast("long").alias("bytes"), F.xxhash64("value").alias("content"), "value")
        text = again.join(part.select(*key).distinct(), key, "left_semi").dropDuplicates(key).join(part, key)
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC)
        whole = text.groupBy("file", "start").agg(F.first("head_bytes").alias("hb"), F.first("length").alias("len"), body.alias("text"))
        payload = F.substring(F.col("text").cast("binary"), (F.col("hb") + 1).cast("int"), F.col("len").cast("int"))
        whole = whole.select("file", F.col("start").alias("offset"), base32_sha1(payload).alias("joined_digest"))
        records = records.join(whole, ["file", "offset"], "left")
    else:
        records = records.withColumn("joined_digest", F.lit(None).cast("string"))
    records = records.join(chain.select("file", F.col("offset").alias("next"), F.lit(True).alias("followed")), ["file", "next"], "left")
    records = records.join(ends, "file")
    read = F.coalesce("body_digest", "joined_digest")
    stated = F.substring_index("stated", "sha1:", -1)
    response = F.col("record_type") == "response"
    return records.select(
        "file", "offset", "page_id", "url", "record_type", "refers_to",
        F.when(response, F.col("length")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, read).otherwise(stated).alias("payload_digest"),
        F.col("length").alias("body_bytes"),
        F.when(response, read == stated).otherwise(F.col("length") == 0).alias("sound"),
        (F.col("followed").isNull() & (F.col("next") < F.col("file_end"))).alias("broken"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


OP9_SQL = """
WITH base AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest
  FROM base),
kept AS (SELECT payload_digest, max(page_id) AS keeper FROM coded GROUP BY payload_digest)
SELECT c.page_id, CAST(c.payload_bytes AS BIGINT) AS payload_bytes, c.payload_digest,
       CASE WHEN c.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN c.page_id = k.keeper THEN NULL ELSE k.keeper END AS refers_to, TRUE AS sound
FROM coded c JOIN kept k USING (payload_digest)
"""
