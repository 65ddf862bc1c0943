"""Q1: the whole per-document audit as one narrow plan.

documents -> triage -> [pii, policy rules, template drift, signatures]
          -> merge (seq) -> enrich (policy text, similar past violations)
          -> suggestions -> score -> decision

All per-document steps are Column expressions over array<struct> columns,
so with the built-in rules the plan is scan -> project: no shuffle; a caller's
rules and policies are joined on the document type.  The only optional shuffle is the similar-violation
search against a non-empty history, done once per distinct search text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.functions.embedders import Embedder
from clausewise.functions.text import explode_rows
from clausewise.functions.vectors import DEFAULT_DIM, buckets
from clausewise.functions.violations import VIOLATION_TYPE, empty_violations, number
from clausewise.operators import decide as dec
from clausewise.operators.drift import BROADCAST_BYTES, PARAGRAPH_SEP, drift_violations, embedded, with_chunks, with_similarities
from clausewise.operators.pii import ConfirmFn, pii_violations
from clausewise.operators.rewrite import apply_fixes, suggestions
from clausewise.operators.rules import CHECKS, policy_violations, rules_checked, rules_table, with_checks
from clausewise.operators.signatures import signature_hits, signature_violations
from clausewise.operators.triage import PREFIX_CHARS, classify
from clausewise.operators.vectors import top_k_similar
from clausewise.session import written
from clausewise.sources.ingest import text_error
from clausewise.sources.reference_texts import POLICIES, policies_table, templates_table

SIMILAR_TOP_K = 3

SIMILAR_TYPE = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.DoubleType())]))

ENRICHED_TYPE = T.StructType(VIOLATION_TYPE.fields + [
    T.StructField("policy_snippet", T.StringType()),
    T.StructField("similar_violations", SIMILAR_TYPE),
])


def policy_map() -> Column:
    """The built-in policy texts as a literal map column."""
    items = sorted(POLICIES.items())
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in items]), F.array(*[F.lit(v) for _, v in items]))


def checked_policies() -> Column:
    """Policy texts of the joined checks, by rule id."""
    pairs = F.transform(F.col(CHECKS), lambda r: F.struct(r["rule_id"].alias("k"), r["policy_snippet"].alias("v")))
    return F.map_from_entries(F.array_distinct(F.filter(pairs, lambda x: x["v"].isNotNull())))


@lru_cache(maxsize=16)
def _scanners(text_col: str, confirm_pii: bool, ctx: str = ""):
    """Scanner expressions for a text column (built once per process: the
    Column trees are large and cost many gateway calls to build)."""
    text = F.col(text_col)
    doc_type = F.col("_cls.document_type")
    return (classify(text), pii_violations(text, confirm=confirm_pii), policy_violations(text, doc_type),
            rules_checked(doc_type), signature_hits(text))


@lru_cache(maxsize=16)
def _tail(text_col: str, ctx: str = ""):
    """Enrichment, suggestion, score and decision expressions (cached)."""
    text = F.col(text_col)
    enriched = F.transform(F.col("_v"), lambda v: F.struct(
        *[v[f.name].alias(f.name) for f in VIOLATION_TYPE.fields],
        F.when(v["rule_id"].isNotNull(), F.try_element_at(F.col("policy_map"), v["rule_id"]))
        .alias("policy_snippet"),
        F.when(F.length(search_text(v)) > 0, F.array().cast(SIMILAR_TYPE)).alias("similar_violations"),
    ))
    return enriched, suggestions(text, F.col("_v")), dec.score(F.col("_v"))


def search_text(v: Column) -> Column:
    """The text a violation is searched by: its matched text, else its message."""
    return F.coalesce(v["text"], v["message"], F.lit(""))


def audit(docs: DataFrame, templates: DataFrame | None = None, policies: DataFrame | None = None,
          history: DataFrame | None = None, rules: DataFrame | None = None,
          id_col: str = "doc_id", text_col: str = "text", metric: str = "l2",
          sep: str = PARAGRAPH_SEP, dim: int = DEFAULT_DIM, with_drift: bool = True,
          confirm_pii: bool = False, rewrite_fn=None, keep_text: bool = True, keep_suggestions: bool = True,
          carry: tuple[str, ...] = (), confirm_fn: ConfirmFn | None = None, classify_fn=None,
          prefix_chars: int | None = PREFIX_CHARS, embedder: Embedder | None = None, vectors_col: str | None = None,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Audit every document.  `history` (id, text[, embedding]) enables the
    similar-past-violation search; None or empty gives empty lists.
    `carry` names input columns passed through unchanged (e.g. a department),
    so callers never need to join the audit back to its input.  With a history the audit
    is written: `keep_text` and `keep_suggestions` off spare what the caller does not read.

    Hooks: `classify_fn(text)` gives struct<document_type, confidence> in place of the
    keyword tests over `prefix_chars` characters; `confirm_fn` judges ambiguous personal
    data (`confirm_pii`); `rewrite_fn` writes suggestions; `embedder` embeds chunks,
    templates and searched violations; `vectors_col` supplies the chunks' vectors."""
    spark = docs.sparkSession
    joined = rules is not None or policies is not None   # the caller's tables: joined on the document type
    text = F.col(text_col)

    ctx = spark.sparkContext.applicationId   # cached Columns belong to one running context
    cls_c, pii_c, pol_c, nrules_c, sig_c = _scanners(text_col, confirm_pii, ctx)
    if classify_fn is not None or prefix_chars != PREFIX_CHARS:
        cls_c = classify(text, prefix_chars) if classify_fn is None else classify_fn(text)
    if confirm_fn is not None:
        pii_c = pii_violations(text, confirm_pii, confirm_fn)
    doc_type = F.col("_cls.document_type")
    vectors = [F.col(vectors_col).alias("_vectors")] if vectors_col else []
    d = docs.select(F.col(id_col), text, *[F.col(c) for c in carry], *vectors).withColumn("_cls", cls_c)
    if joined:
        d = with_checks(d, doc_type, rules_table(spark) if rules is None else rules,
                        policies_table(spark) if policies is None else policies)
        pol_c, nrules_c = policy_violations(text, doc_type, F.col(CHECKS)), rules_checked(doc_type, F.col(CHECKS))
    d = d.withColumn("policy_map", checked_policies() if joined else policy_map())

    none = F.array().cast("array<struct<chunk_index:int,chunk:string,span_start:int,span_end:int>>")
    d = with_chunks(d, text_col, sep) if with_drift else d.withColumn("_chunks", none)
    # scanners (each result bound in its own column)
    d = d.select("*", pii_c.alias("_pii"), pol_c.alias("_pol"), nrules_c.alias("rules_checked"),
                 sig_c.alias("_sig_hits"))
    drift_c = empty_violations()
    if with_drift:
        d, has_store = with_similarities(d, templates if templates is not None else templates_table(spark), "_chunks", metric=metric, dim=dim,
                                         broadcast_bytes=broadcast_bytes, embedder=embedder, vectors_col="_vectors" if vectors_col else None)
        drift_c = drift_violations(F.col("_chunks"), F.col("_sims"), has_store)
    d = d.select("*", drift_c.alias("_drift"),
                 signature_violations(text, doc_type, F.col("_sig_hits")).alias("_sig"))
    d = d.withColumn("_v", number(F.concat("_pii", "_pol", "_drift", "_sig")))

    # enrichment E1 (policy text by rule id); E2 handled below
    has_history = history is not None and history.limit(1).count() > 0
    enriched_c, sugg_c, score_c = _tail(text_col, ctx)
    d = d.withColumn("violations", enriched_c)
    d = d.withColumn("suggestions", sugg_c if rewrite_fn is None else suggestions(text, F.col("_v"), rewrite_fn))
    d = d.withColumn("_score", score_c)
    # one suggestion per violation, so size(_v) == size(suggestions); using it
    # lets queries that do not read suggestions skip building them
    d = d.withColumn("_dec", dec.decide(F.col("_score.violation_score"), F.size("_v")))

    # a text that cannot be read is an error row: it gets no decision
    d = d.withColumn("_error", text_error(text))
    unread = F.col("_error").isNotNull()
    out = d.select(
        F.col(id_col), *([text] if keep_text else []), *[F.col(c) for c in carry],
        F.col("_cls.document_type").alias("document_type"),
        F.col("_cls.confidence").alias("classification_confidence"),
        "violations", *(["suggestions"] if keep_suggestions else []),
        F.col("_score.violation_score").alias("violation_score"),
        F.col("_score.critical").alias("n_critical"), F.col("_score.high").alias("n_high"),
        F.col("_score.medium").alias("n_medium"), F.col("_score.low").alias("n_low"),
        F.when(~unread, F.col("_dec.decision")).alias("decision"),
        F.when(unread, F.col("_error")).otherwise(F.col("_dec.reason")).alias("reason"),
        F.when(unread, F.lit("error")).otherwise(F.lit("ok")).alias("status"), F.col("_error").alias("error"),
        F.size("_pii").alias("pii_found"), F.size("_pol").alias("policy_found"), "rules_checked",
        F.size("_chunks").alias("chunks_checked"), F.size("_drift").alias("drift_found"),
        F.size("_sig_hits").alias("signatures_found"), F.size("_sig").alias("signature_violations"),
    )
    if has_history:
        out = attach_similar(out, history, id_col, dim, metric, embedder)
    return out


SALTS = 32            # shares of a frequent search text's violations in the join back
FREQUENT = 1000       # violations of a search text from which it is frequent ...
MAX_FREQUENT = 10_000  # ... raised until so few texts are


def similar_violations_long(audits: DataFrame, history: DataFrame, id_col: str = "doc_id",
                            dim: int = DEFAULT_DIM, metric: str = "l2", embedder: Embedder | None = None) -> DataFrame:
    """E2 in long form: (id, seq, rank, history_id, history_text, similarity,
    distance) for every violation with a non-empty search text."""
    found = similar_lists(audits, history, id_col, dim, metric, embedder)
    return found.select(id_col, "seq", F.explode("_s").alias("s")).select(
        id_col, "seq", "s.rank", F.col("s.id").alias("history_id"), F.col("s.text").alias("history_text"), "s.similarity", "s.distance")


def similar_lists(audits: DataFrame, history: DataFrame, id_col: str = "doc_id",
                  dim: int = DEFAULT_DIM, metric: str = "l2", embedder: Embedder | None = None) -> DataFrame:
    """(id, seq, _s): the hits of each violation with a non-empty search text, by rank.

    The search runs once per distinct text (written once, with its number of violations).
    Message texts repeat across huge numbers of violations, so the join back of
    frequent ones is salted: each violation takes one of SALTS shares of its text, and the
    text's hits are there once per share.  The other texts' hits are there once."""
    hv = (history.select(F.col("id").cast("string").alias("id"), "text", "embedding")
          if "embedding" in history.columns else history_vectors(history, dim, embedder))
    long = (explode_rows(audits, [id_col], F.col("violations"), "_i", "v")
            .select(id_col, F.col("v.seq").alias("seq"), search_text(F.col("v")).alias("_q"))
            .where(F.length("_q") > 0))
    texts = written(long.groupBy("_q").agg(F.count(F.lit(1)).alias("_n")), "search-texts")
    asked = texts.select("_q", (embedder.column(F.col("_q")) if embedder else buckets(F.col("_q"), dim)).alias("_vec"))
    hits = top_k_similar(asked, hv, SIMILAR_TOP_K, metric, query_id="_q", query_vec="_vec", query_kind="dense" if embedder else "bag",
                         store_id="id", store_vec="embedding", payload_cols=["text"])
    lists = hits.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "text", "similarity", "distance"))).alias("_s"))
    least = max(FREQUENT, (texts.agg(F.sum("_n")).first()[0] or 0) / MAX_FREQUENT)
    frequent = F.broadcast(texts.where(F.col("_n") >= least).select(F.xxhash64("_q").alias("_h")).distinct().withColumn("_often", F.lit(True)))

    def told(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_h", F.xxhash64("_q")).join(frequent, "_h", "left").drop("_h")

    shares = F.sequence(F.lit(0), F.when(F.col("_often"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    dealt = told(lists).withColumn("_salt", F.explode(shares)).drop("_often")
    salt = F.when(F.col("_often"), F.pmod(F.xxhash64(id_col, "seq"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salted = told(long).withColumn("_salt", salt).drop("_often")
    return salted.join(dealt, ["_q", "_salt"]).drop("_q", "_salt")


def attach_similar(audits: DataFrame, history: DataFrame, id_col: str = "doc_id",
                   dim: int = DEFAULT_DIM, metric: str = "l2", embedder: Embedder | None = None) -> DataFrame:
    """E2 nested into each violation (the reference's shape).  The audit is
    written once (it feeds both the search and the final rows; the search reads its
    violations only), the long-form results are regrouped per document and
    joined back."""
    audits = written(audits, "audited")
    per_doc = (similar_lists(audits, history, id_col, dim, metric, embedder)
               .repartition(id_col)   # one shuffle for both groupings
               .groupBy(id_col, "seq").agg(F.sort_array(F.flatten(F.collect_list("_s"))).alias("_s"))
               .groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("seq", "_s"))).alias("_m")))

    def attach(v: Column) -> Column:
        found = F.try_element_at(F.col("_m"), v["seq"])
        lst = F.transform(found, lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"),
                                                    s["similarity"].alias("similarity"),
                                                    s["distance"].alias("distance")))
        return v.withField("similar_violations", F.when(
            F.length(search_text(v)) > 0, F.coalesce(lst, F.array().cast(SIMILAR_TYPE))))

    return (audits.join(per_doc, id_col, "left")
            .withColumn("violations", F.transform("violations", attach)).drop("_m"))


def history_vectors(history: DataFrame, dim: int = DEFAULT_DIM, embedder: Embedder | None = None) -> DataFrame:
    """History rows (id, text) embedded by the hashed rule or the caller's model."""
    return history.select(F.col("id").cast("string").alias("id"), F.col("text"), embedded(F.col("text"), dim, embedder).alias("embedding"))


def final_text(audits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """F1 for documents decided Auto-Fix: the text with all suggestions applied."""
    return (audits.where(F.col("decision") == "Auto-Fix")
            .select(id_col, apply_fixes(F.col(text_col), F.col("suggestions")).alias("final_text")))

