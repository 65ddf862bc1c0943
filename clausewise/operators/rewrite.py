"""W1-W2 suggestions, F1 applying fixes, F2 change segments.

Suggestions are built per violation with `transform`; the generator for
non-PII violations is a Column function parameter, so a caller may plug in a
pandas UDF; the default is the deterministic stub of the reference.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.functions.text import apply_edits, cut, explode_rows, let, slice_cut, slice_text
from clausewise.functions.violations import SUGGESTION_TYPE
from clausewise.operators.pii import redact

# Fixed values (must equal the reference's rewrite stub).
PII_REPLACEMENT = "[REDACTED]"
FIX_SUFFIX = " [COMPLIANCE FIX APPLIED]"
FIX_EXPLANATION = ["Applied policy compliance fix", "Maintains document intent",
                   "Follows template guidelines"]
FIX_CITATIONS = ["POLICY_001"]

# generate(redacted_span) -> struct<replacement, explanation, citations, redaction_flag>
RewriteFn = Callable[[Column], Column]


def stub_rewrite(redacted_span: Column) -> Column:
    return F.struct(
        F.concat(redacted_span, F.lit(FIX_SUFFIX)).alias("replacement"),
        F.array(*[F.lit(e) for e in FIX_EXPLANATION]).alias("explanation"),
        F.array(*[F.lit(c) for c in FIX_CITATIONS]).alias("citations"),
        F.lit(False).alias("redaction_flag"),
    )


def _pii_spans(violations: Column) -> Column:
    """PII spans of a document by start: array<struct<s, i, e>>, i their order."""
    found = F.transform(F.filter(violations, lambda v: v["type"] == "pii"), lambda v, i: F.struct(
        F.coalesce(v["span_start"], F.lit(0)).alias("s"), i.alias("i"), F.coalesce(v["span_end"], F.lit(0)).alias("e")))
    return F.array_sort(found)


def _span_ranges(violations: Column, pii: Column) -> Column:
    """array<int>: for violation j the number of PII spans that start before its end (at
    2j), and of those that start too far before it to reach it (at 2j + 1).

    One sweep: bounds and span starts are sorted together; a bound's place less
    the bounds before it is the number of starts before it."""
    longest = F.coalesce(F.array_max(F.transform(pii, lambda p: p["e"] - p["s"])), F.lit(0))

    def bounds(reach: Column) -> Column:
        of = lambda v, name: F.coalesce(v[name], F.lit(0))
        ends = F.transform(violations, lambda v, j: F.struct(of(v, "span_end").alias("x"), (2 * j).alias("j")))
        starts = F.transform(violations, lambda v, j: F.struct((of(v, "span_start") - reach + 1).alias("x"), (2 * j + 1).alias("j")))
        keys = F.transform(pii, lambda p: F.struct(p["s"].alias("x"), F.lit(2**31 - 1).alias("j")))  # behind the bounds at its place
        return F.array_sort(F.concat(ends, starts, keys))

    places = let(longest, lambda reach: F.transform(bounds(reach), lambda b, k: F.struct(b["j"].alias("j"), k.alias("k"))))
    counted = F.transform(F.filter(places, lambda b: b["j"] < 2**31 - 1), lambda b, t: F.struct(b["j"].alias("j"), (b["k"] - t).alias("n")))
    return F.transform(F.array_sort(counted), lambda b: b["n"])


def clipped_pii(pii: Column, ranges: Column, j: Column, start: Column, end: Column) -> Column:
    """PII spans that meet violation j, moved into slice coordinates and clipped to the
    slice, so the slice is redacted where the PII really is (the reference
    applies document offsets to the slice; see README, deviations)."""
    above, below = F.get(ranges, 2 * j), F.get(ranges, 2 * j + 1)
    near = F.slice(pii, below + 1, F.greatest(above - below, F.lit(0)))
    moved = F.transform(near, lambda p: F.struct(
        (F.greatest(p["s"], start) - start).alias("span_start"), (F.least(p["e"], end) - start).alias("span_end"), p["i"].alias("i")))
    return F.filter(moved, lambda p: p["span_start"] < p["span_end"])


def suggestions(text: Column, violations: Column, rewrite_fn: RewriteFn | None = None) -> Column:
    """array<suggestion>, one per violation, in violation order."""
    rewrite_fn = rewrite_fn or stub_rewrite
    src = F.coalesce(text, F.lit(""))

    def one(v: Column, j: Column, x: Column) -> Column:
        # the slice, then its redacted form, each bound once; personal data needs neither
        is_pii = F.coalesce(v["type"] == "pii", F.lit(False))
        return let(F.when(~is_pii, slice_cut(x["cut"], v["span_start"], v["span_end"])), lambda span: let(
            F.when(~is_pii, redact(span, clipped_pii(x["pii"], x["ranges"], j, v["span_start"], v["span_end"]), "i")),
            lambda redacted: build(v, is_pii, span, rewrite_fn(redacted))))

    def build(v: Column, is_pii: Column, span: Column, gen: Column) -> Column:
        return F.struct(
            F.when(is_pii, v["pii_type"]).otherwise(F.coalesce(v["rule_id"], v["type"])).alias("violation_id"),
            v["span_start"].alias("span_start"),
            v["span_end"].alias("span_end"),
            F.when(is_pii, v["text"]).otherwise(span).alias("original_text"),
            F.when(is_pii, F.lit(PII_REPLACEMENT)).otherwise(gen["replacement"]).alias("replacement"),
            F.when(is_pii, F.array(F.concat(F.lit("Redact "), v["pii_type"], F.lit(" to protect privacy"))))
            .otherwise(gen["explanation"]).alias("explanation"),
            F.when(is_pii, F.lit(None).cast(T.ArrayType(T.StringType())))
            .otherwise(gen["citations"]).alias("citations"),
            F.when(is_pii, F.lit(True)).otherwise(gen["redaction_flag"]).alias("redaction_flag"),
        ).cast(SUGGESTION_TYPE)

    # bound one after another: the text's pieces, the spans by start, the spans each violation may meet
    bound = let(_pii_spans(violations), lambda pii: F.struct(cut(src).alias("cut"), pii.alias("pii"), _span_ranges(violations, pii).alias("ranges")))
    return let(bound, lambda x: F.transform(violations, lambda v, j: one(v, j, x)))


def apply_fixes(text: Column, suggs: Column) -> Column:
    """apply every suggestion right to left (stable on equal starts)."""
    edits = F.transform(suggs, lambda s, i: F.struct(
        F.coalesce(s["span_start"], F.lit(0)).alias("span_start"),
        F.coalesce(s["span_end"], F.lit(0)).alias("span_end"),
        F.coalesce(s["replacement"], F.lit("")).alias("replacement"),
        i.alias("ord")))
    return apply_edits(text, edits)


def change_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    sugg_col: str = "suggestions") -> DataFrame:
    """(id, seg, op, text) rows describing the edit as equal / delete /
    insert runs, ordered by position; equal and insert texts in order are F1's
    final text.  From the first edit that overlaps its successor (or starts
    with it) on, the edits are one region: their union is deleted and what the
    sequential rule leaves is inserted."""
    src = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(id_col, src.alias("t"), apply_fixes(src, F.col(sugg_col)).alias("final"), F.array_sort(
        F.transform(F.coalesce(F.col(sugg_col), F.array().cast(T.ArrayType(SUGGESTION_TYPE))), lambda s, i: F.struct(
            F.coalesce(s["span_start"], F.lit(0)).alias("s"), i.alias("i"), F.coalesce(s["span_end"], F.lit(0)).alias("e"),
            F.coalesce(s["replacement"], F.lit("")).alias("r")))).alias("ed"))
    n = F.size("ed")
    # the first edit of the region (n if no two edits meet)
    meets = F.filter(F.sequence(F.lit(0), n), lambda k: (k + 1 < n) & (
        (F.get("ed", k + 1)["s"] < F.get("ed", k)["e"]) | (F.get("ed", k + 1)["s"] == F.get("ed", k)["s"])))
    d = d.withColumn("from", F.coalesce(F.get(meets, 0), n).cast("int"))
    d = d.withColumn("alone", F.slice("ed", F.lit(1), F.col("from"))).withColumn("region", F.slice("ed", F.col("from") + 1, F.greatest(n - F.col("from"), F.lit(0))))
    t = F.col("t")
    pieces = F.transform("alone", lambda e, k: F.array(
        F.struct(F.lit("equal").alias("op"),
                 slice_text(t, F.when(k == 0, F.lit(0)).otherwise(F.get("alone", k - 1)["e"]), e["s"]).alias("text")),
        F.struct(F.lit("delete").alias("op"), slice_text(t, e["s"], e["e"]).alias("text")),
        F.struct(F.lit("insert").alias("op"), e["r"].alias("text"))))
    d = d.withColumn("head", F.flatten(pieces)).withColumn("last", F.coalesce(F.get("alone", F.size("alone") - 1)["e"], F.lit(0)))
    # the region: its start, the end of its union, the text behind it, and the final text from its start on
    d = (d.withColumn("rs", F.coalesce(F.get("region", 0)["s"], F.length(t)))
         .withColumn("re", F.coalesce(F.array_max(F.transform("region", lambda e: e["e"])), F.length(t))))
    d = d.withColumn("between", slice_text(t, F.col("last"), F.col("rs"))).withColumn("behind", F.substr(t, F.col("re") + 1))
    kept = F.aggregate(F.filter("head", lambda p: p["op"] != "delete"), F.lit(0), lambda a, p: a + F.length(p["text"])) + F.length("between")
    d = d.withColumn("left", F.substr("final", kept + 1))
    d = d.withColumn("clean", F.endswith(F.col("left"), F.col("behind")))
    clean = F.col("clean")
    d = d.withColumn("behind", F.when(clean, F.col("behind")).otherwise(F.lit("")))
    cut = F.when(clean, slice_text(t, F.col("rs"), F.col("re"))).otherwise(F.substr(t, F.col("rs") + 1))
    new = F.substr("left", F.lit(1), F.greatest(F.length("left") - F.length("behind"), F.lit(0)))

    def seg(op: str, text: Column) -> Column:
        return F.struct(F.lit(op).alias("op"), text.alias("text"))

    segs = F.filter(F.concat("head", F.array(
        seg("equal", F.col("between")),
        seg("delete", F.when(F.size("region") > 0, cut).otherwise(F.lit(""))),
        seg("insert", F.when(F.size("region") > 0, new).otherwise(F.lit(""))),
        seg("equal", F.when(F.size("region") > 0, F.col("behind")).otherwise(F.lit(""))))), lambda p: F.length(p["text"]) > 0)
    return (explode_rows(d.select(id_col, segs.alias("segs")), [F.col(id_col)], F.col("segs"), "seg", "p")
            .select(id_col, F.col("seg").cast("int").alias("seg"), "p.op", "p.text"))


def template_context(audits: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     dim: int | None = None, metric: str = "l2", embedder=None) -> DataFrame:
    """For every non-PII violation, the template closest to its text
    slice (the context a rewrite generator receives; the stub ignores it).

    The narrow rows (key and the slice's token bag, or its vector by the caller's
    `embedder`) are written first, so the audit behind them runs once; they are then
    searched in the template store (`top_k_similar`, k = 1).  Returns
    (id, seq, template_id, similarity)."""
    from clausewise.functions.vectors import DEFAULT_DIM, buckets
    from clausewise.operators.drift import template_vectors
    from clausewise.operators.vectors import top_k_similar
    from clausewise.session import written
    dim = dim or DEFAULT_DIM
    src = F.coalesce(F.col(text_col), F.lit(""))
    v = explode_rows(audits, [id_col, text_col], F.col("violations")).where(F.col("v.type") != "pii")
    v = v.select(F.concat_ws(":", F.col(id_col).cast("string"), F.col("v.seq").cast("string")).alias("_key"),
                 slice_text(src, F.col("v.span_start"), F.col("v.span_end")).alias("_slice"))
    v = written(v.select("_key", (embedder.column(F.col("_slice")) if embedder else buckets(F.col("_slice"), dim)).alias("_vec")), "context-queries")
    best = top_k_similar(v, template_vectors(templates, dim, embedder=embedder), 1, metric, query_id="_key", query_vec="_vec",
                         query_kind="dense" if embedder else "bag")
    # the key encodes (id, seq)
    id_type = audits.schema[id_col].dataType
    return best.select(
        F.regexp_extract("_key", r"(?s)^(.*):([0-9]+)$", 1).cast(id_type).alias(id_col),
        F.regexp_extract("_key", r"(?s)^(.*):([0-9]+)$", 2).cast("int").alias("seq"),
        F.col("id").alias("template_id"), "similarity")
