"""D1 paragraph chunks and D4 template drift.

The template store is embedded in Spark (dense, unit length), last write per id.
Up to BROADCAST_BYTES of matrix it is broadcast and every document finds, per
chunk, its best template in place (one matrix product per Arrow batch, no
shuffle); beyond, chunks go through the blocked top-k kernel.  Both give the
same similarities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.dense import best_match_for_bags, dense_vectors
from clausewise.functions.embedders import Embedder, best_of_vectors
from clausewise.functions.search import first_occurrences
from clausewise.functions.text import explode_rows, split_paragraphs
from clausewise.functions.vectors import DEFAULT_DIM, buckets
from clausewise.functions.violations import empty_violations, violation
from clausewise.operators.vectors import top_k_similar, upsert_vectors
from clausewise.session import written

# Fixed values (must equal the reference's detector).
SIMILARITY_THRESHOLD = 0.7
MEDIUM_ABOVE = 0.5
MIN_CHUNK_CHARS = 50          # a chunk must be longer than this
PARAGRAPH_SEP = "\n\n"
NO_TEMPLATE_MESSAGE = "No matching template found"
BROADCAST_BYTES = 32_000_000


FEW_CHUNKS = 64   # of a document, up to which each is searched in its text


def chunks(text: Column, sep: str = PARAGRAPH_SEP) -> Column:
    """array<struct<chunk_index, chunk, span_start, span_end>>; span_start
    is the first occurrence of the chunk in the text, each searched from its start
    (`with_chunks` finds those of documents with many chunks together)."""
    kept, src = _kept(text, sep), F.coalesce(text, F.lit(""))
    return _chunk_structs(kept, F.transform(kept, lambda c: F.instr(src, c) - 1))


def _kept(text: Column, sep: str) -> Column:
    return F.filter(split_paragraphs(text, sep), lambda p: F.length(p) > MIN_CHUNK_CHARS)


def _chunk_structs(kept: Column, places: Column) -> Column:
    pairs = F.zip_with(kept, places, lambda c, at: F.struct(c.alias("c"), at.alias("at")))
    return F.transform(pairs, lambda x, i: F.struct(
        i.alias("chunk_index"), x["c"].alias("chunk"), x["at"].alias("span_start"), (x["at"] + F.length(x["c"])).alias("span_end")))


def with_chunks(docs: DataFrame, text_col: str = "text", sep: str = PARAGRAPH_SEP, out: str = "_chunks") -> DataFrame:
    """`docs` with its chunks (D1) in `out`, in time that grows with the text: the
    paragraphs are cut once, and a document of many is searched for all of them at once."""
    src = F.coalesce(F.col(text_col), F.lit(""))
    many = F.size("_kept") > FEW_CHUNKS
    cut = docs.withColumn("_kept", _kept(F.col(text_col), sep))
    cut = cut.withColumn("_far", first_occurrences(F.when(many, src), F.when(many, F.col("_kept"))))
    places = F.when(many, F.col("_far")).otherwise(F.transform("_kept", lambda c: F.instr(src, c) - 1))
    return cut.withColumn(out, _chunk_structs(F.col("_kept"), places)).drop("_kept", "_far")


def drift_violations(cs: Column, sims: Column, has_store: bool = True) -> Column:
    """D4 as array<violation> for one document, from its chunks and their best
    similarities (see `with_similarities`)."""

    def judge(c: Column, sim_raw: Column) -> Column:
        sim = F.coalesce(sim_raw, F.lit(0.0))
        flag = (sim < SIMILARITY_THRESHOLD) if has_store else F.lit(True)
        return F.struct(flag.alias("flag"), violation(
            scanner="template", type="template_drift", chunk_index=c["chunk_index"],
            span_start=c["span_start"], span_end=c["span_end"],
            similarity=sim if has_store else F.lit(0.0),
            threshold=F.lit(SIMILARITY_THRESHOLD) if has_store else None,
            severity=(F.when(sim > MEDIUM_ABOVE, F.lit("medium")).otherwise(F.lit("high"))
                      if has_store else "low"),
            message=(F.concat(F.lit("Chunk deviates from template (similarity: "),
                              F.format_number(sim, 2), F.lit(")")) if has_store else NO_TEMPLATE_MESSAGE),
        ).alias("v"))

    scored = F.zip_with(cs, sims, judge)
    return F.coalesce(F.transform(F.filter(scored, lambda x: x["flag"]), lambda x: x["v"]),
                      empty_violations())


def template_vectors(templates: DataFrame, dim: int = DEFAULT_DIM, id_col: str = "template_id", text_col: str = "text",
                     embedder: Embedder | None = None) -> DataFrame:
    """(id, embedding): of several templates with one id the last stored counts
    (without a time, the greatest text).  A column `embedding` supplies the vectors;
    else texts are embedded, by the hashed rule or the caller's model."""
    at = F.col("stored_at") if "stored_at" in templates.columns else F.lit(None).cast("timestamp")
    given = "embedding" in templates.columns
    vector = [F.col("embedding").cast("array<double>").alias("embedding")] if given else []
    text = F.col(text_col) if text_col in templates.columns else F.lit(None).cast("string")
    last = upsert_vectors(templates.select(F.col(id_col).alias("id"), at.alias("at"), text.alias("t"), *vector), "id", ("at", "t"))
    return last.select("id", "embedding") if given else last.select("id", embedded(F.col("t"), dim, embedder).alias("embedding"))


def embedded(text: Column, dim: int = DEFAULT_DIM, embedder: Embedder | None = None) -> Column:
    return embedder.column(text) if embedder else dense_vectors(buckets(text, dim), dim)


def with_similarities(docs: DataFrame, templates: DataFrame, chunk_col: str, out: str = "_sims", metric: str = "l2",
                      dim: int = DEFAULT_DIM, broadcast_bytes: int = BROADCAST_BYTES, embedder: Embedder | None = None,
                      vectors_col: str | None = None) -> tuple[DataFrame, bool]:
    """(`docs` with the best template similarity of each chunk in `out`,
    whether there is any template).

    Chunks are embedded by the hashed rule, by the caller's `embedder`, or their
    vectors are supplied: `vectors_col`, array<array<double>> in chunk order."""
    spark = docs.sparkSession
    store = template_vectors(templates, dim, embedder=embedder)
    n, size = store.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    chunk_texts = F.transform(F.col(chunk_col), lambda c: c["chunk"])
    if docs.isStreaming and n * (size or dim) * 8 > broadcast_bytes:
        raise ValueError("templates too large to broadcast: audit the stream by micro-batches (streaming.audit_stream)")
    if n * (size or dim) * 8 <= broadcast_bytes:
        m = np.array([r["embedding"] for r in store.select("embedding").collect()], dtype=np.float64).reshape(n, size or dim)
        bc = spark.sparkContext.broadcast((m, (m * m).sum(axis=1)))
        if vectors_col:
            sims = best_of_vectors(F.col(vectors_col), bc, metric)
        elif embedder:
            sims = embedder.best_similarities(chunk_texts, bc, metric)
        else:
            sims = best_match_for_bags(F.transform(F.col(chunk_col), lambda c: buckets(c["chunk"], dim)), bc, dim, metric)
        return docs.withColumn(out, sims), n > 0
    # only the similarity counts, so equal vectors of the store are searched once
    store = store.groupBy("embedding").agg(F.min("id").alias("id"))
    # what is searched is bound beside the row's key (one that survives recomputation); the chunk's text is not needed behind it
    if vectors_col:
        asked, kind = F.col(vectors_col), "dense"
    elif embedder:
        asked, kind = chunk_texts, "dense"
    else:
        asked, kind = F.transform(F.col(chunk_col), lambda c: buckets(c["chunk"], dim)), "bag"
    bare = F.transform(F.col(chunk_col), lambda c: c.withField("chunk", F.lit(None).cast("string")))
    held = written(docs.withColumns({"_row": F.expr("uuid()"), "_asked": asked}).withColumn(chunk_col, bare), "drift-documents")
    rows = held.drop("_asked")
    each = held.select("_row", F.posexplode("_asked").alias("_i", "embedding"))
    if embedder and not vectors_col:
        each = written(each.select("_row", "_i", embedder.column(F.col("embedding")).alias("embedding")), "drift-chunks")
    each = each.select(F.concat_ws(":", "_row", "_i").alias("query_id"), "embedding")
    best = top_k_similar(each, store, 1, metric, query_kind=kind)
    key = F.split("query_id", ":")
    sims = best.groupBy(F.get(key, 0).alias("_row")).agg(F.sort_array(F.collect_list(F.struct(
        F.get(key, 1).cast("int").alias("i"), "similarity"))).alias("_s"))
    return rows.join(sims, "_row", "left").withColumn(out, F.coalesce(
        F.transform("_s", lambda x: x["similarity"]), F.array().cast("array<double>"))).drop("_row", "_s"), True


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                sep: str = PARAGRAPH_SEP) -> DataFrame:
    """D1 as rows: (id, chunk_index, span_start, span_end, chunk_chars)."""
    return (explode_rows(with_chunks(docs.select(id_col, F.col(text_col).alias("_text")), "_text", sep), [id_col], F.col("_chunks"), val="c")
            .select(id_col, F.col("c.chunk_index").cast("int").alias("chunk_index"),
                    "c.span_start", "c.span_end", F.length("c.chunk").alias("chunk_chars")))


def detect_drift(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 metric: str = "l2", sep: str = PARAGRAPH_SEP, dim: int = DEFAULT_DIM, embedder: Embedder | None = None,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """D4 as rows: one per drifting chunk."""
    scored, has = with_similarities(with_chunks(docs.select(id_col, F.col(text_col).alias("_text")), "_text", sep).drop("_text"), templates, "_chunks", metric=metric, dim=dim,
                                         broadcast_bytes=broadcast_bytes, embedder=embedder)
    return drift_rows(scored, id_col, has)


def drift_of_vectors(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", chunk_col: str = "chunks", vectors_col: str = "vectors",
                     metric: str = "l2", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """D4 on supplied vectors: documents with their chunks (the structs of
    `chunks`) and one vector per chunk, templates with `embedding`."""
    return drift_rows(*_renamed(with_similarities(docs, templates, chunk_col, metric=metric, broadcast_bytes=broadcast_bytes, vectors_col=vectors_col),
                                id_col, chunk_col))


def _renamed(scored: tuple[DataFrame, bool], id_col: str, chunk_col: str) -> tuple[DataFrame, str, bool]:
    return scored[0].select(id_col, F.col(chunk_col).alias("_chunks"), "_sims"), id_col, scored[1]


def drift_rows(scored: DataFrame, id_col: str, has: bool) -> DataFrame:
    v = drift_violations(F.col("_chunks"), F.col("_sims"), has)
    return (explode_rows(scored, [id_col], v)
            .select(id_col, F.col("v.chunk_index").alias("chunk_index"), "v.span_start", "v.span_end",
                    F.round("v.similarity", 6).alias("similarity"), "v.severity", "v.message"))


__all__ = ["chunks", "with_chunks", "drift_violations", "with_similarities", "chunk_table", "detect_drift", "drift_of_vectors"]
