"""Column-expression text primitives (all JVM side, no Python per row).

Spans are 0-based, half-open, counted in code points like Python string
indices; Spark's `length`/`substr` also count code points, so offsets line up.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.functions.regex import SPACE, to_java

SPAN_FIELDS = "span_start int, span_end int, text string"


def _empty_spans() -> Column:
    return F.array().cast(f"array<struct<{SPAN_FIELDS}>>")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and pass it to `body` as a lambda variable.

    Expressions referenced inside a higher-order lambda are re-evaluated for
    every element; binding them first keeps regex, split and hashing work
    linear."""
    return F.get(F.transform(F.array(value), body), 0)


def finditer(text: Column, pattern: str, ignore_case: bool = False,
             translate: bool = True, prefilter: str | None = None) -> Column:
    """Non-overlapping matches of a Python pattern as
    `array<struct<span_start:int, span_end:int, text:string>>`, left to right.

    `regexp_extract_all` yields the matched texts and `split(.., -1)` the text
    between them (both walk the same `Matcher.find` sequence); the start of
    match i is the length of everything before it, a prefix sum over
    `len(part_j) + len(match_j)`.  NULL text yields an empty array.

    `prefilter` is an optional cheap Java pattern that every match must
    contain (a necessary condition); texts without it skip the exact pattern.
    """
    java = to_java(pattern, ignore_case) if translate else pattern
    src = F.coalesce(text, F.lit(""))

    def with_parts(ms: Column, parts: Column) -> Column:
        steps = F.zip_with(F.slice(parts, 1, F.size(ms)), ms,
                           lambda p, m: F.length(p) + F.length(m))
        # exclusive prefix sums: offsets[i] = end of match i-1 (0 for i = 0)
        offsets = F.aggregate(steps, F.array(F.lit(0)),
                              lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))
        return let(offsets, lambda offs: F.transform(ms, lambda m, i: let(
            F.get(offs, i) + F.length(F.get(parts, i)),
            lambda start: F.struct(start.alias("span_start"),
                                   (start + F.length(m)).alias("span_end"),
                                   m.alias("text")))))

    found = let(F.regexp_extract_all(src, F.lit(java), 0), lambda ms: F.when(
        F.size(ms) > 0, let(F.split(src, java, -1), lambda parts: with_parts(ms, parts)))
        .otherwise(_empty_spans()))
    if prefilter is None:
        return found
    return F.when(src.rlike(prefilter), found).otherwise(_empty_spans())


def explode_rows(df, keep: list, arr: Column, pos: str | None = None, val: str = "v"):
    """One row per element of `arr` (none for an empty or NULL array).

    Uses the outer generator and filters on the position above it.  With an
    inner explode the optimizer infers `size(arr) > 0` and pushes it below the
    projection that computes `arr`, substituting the whole array expression
    into the filter, which then evaluates it a second time."""
    p = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(arr).alias(p, val)).where(F.col(p).isNotNull())
    return out if pos else out.drop(p)


# Python's whitespace set (`str.isspace()`), derived by rule over all code points.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())


def py_strip(col: Column) -> Column:
    """Python `str.strip()`: Spark's native trim with Python's whitespace set
    (cheaper than a regex at both ends)."""
    return F.trim(col, F.lit(PY_WHITESPACE))


def split_paragraphs(text: Column, sep: str = "\n\n") -> Column:
    """`[p.strip() for p in text.split(sep) if p.strip()]` as an array column."""
    parts = F.split(F.coalesce(text, F.lit("")), re.escape(sep), -1)
    return F.filter(F.transform(parts, py_strip), lambda p: F.length(p) > 0)


def contains_any(lowered: Column, keywords) -> Column:
    """Raw substring test of any keyword (reference keyword semantics)."""
    if isinstance(keywords, Column):
        return F.exists(keywords, lambda k: F.contains(lowered, k))
    cond = F.lit(False)
    for k in keywords:
        cond = cond | lowered.contains(k)
    return cond


def short_sha256(col: Column, n: int) -> Column:
    """First `n` hex characters of sha256 over the UTF-8 bytes."""
    return F.substring(F.sha2(col, 256), 1, n)


PIECE = 512            # code points of a piece of a long text
LONG = 8 * PIECE


def cut(text: Column) -> Column:
    """A text ready to be sliced many times: struct<width, pieces>.  Finding an
    offset in a string costs its distance from the start, so a long text is cut into
    pieces of `width` code points once and a slice reads only those it touches."""
    long = F.length(text) > LONG
    return F.struct(
        F.when(long, F.lit(PIECE)).otherwise(F.greatest(F.length(text), F.lit(1))).alias("width"),
        F.when(long, F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))).otherwise(F.array(text)).alias("pieces"))


def slice_cut(pieces: Column, start: Column, end: Column) -> Column:
    """`slice_text` of a `cut` text."""
    start = F.greatest(start, F.lit(0))
    width = pieces["width"]
    first, last = F.floor(start / width).cast("int"), F.floor((end - 1) / width).cast("int")
    near = F.array_join(F.slice(pieces["pieces"], first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substr(near, start - first * width + 1, end - start)).otherwise(F.lit(""))


def apply_edits(text: Column, edits: Column) -> Column:
    """Replace spans right to left, like repeated
    `out = out[:start] + replacement + out[end:]` over edits sorted by start
    descending (stable: input order breaks ties).

    `edits` is `array<struct<span_start, span_end, replacement, ord>>` where
    `ord` is the input position.  Overlapping edits use their original
    offsets on the already edited text, exactly as the sequential rule does.

    The result is written from left to right, from the last edit applied to the first: all that
    an edit needs to know is how far the ones before it (in the text) have cut into what
    it leaves.  With p that place in the text as it stood after the edit, it adds text[p:start] and
    its replacement, or the part of the replacement from p on, or nothing, and hands on a place in
    the text as it stood before the edit.  Only edits that start behind the
    text's end are replayed one by one.
    """
    def ordered(edits: Column) -> Column:
        return F.array_sort(F.transform(edits, lambda e: F.struct(
            e["span_start"].alias("at"), (-e["ord"]).alias("o"), F.greatest(e["span_start"], F.lit(0)).alias("s"),
            F.greatest(e["span_end"], F.lit(0)).alias("e"), e["replacement"].alias("r"))))

    def after(p: Column, e: Column) -> Column:
        return e["e"] + F.greatest(p - e["s"] - F.length(e["r"]), F.lit(0))

    def written(t: Column, a: Column) -> Column:
        places = F.aggregate(a, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(after(F.get(acc, F.size(acc) - 1), e))))
        return let(F.struct(cut(t).alias("c"), places.alias("p")), lambda x: F.concat(
            F.array_join(F.transform(a, lambda e, k: let(F.get(x["p"], k), lambda p: F.when(
                p < e["s"], F.concat(slice_cut(x["c"], p, e["s"]), e["r"])).otherwise(F.substr(e["r"], p - e["s"] + 1)))), ""),
            slice_cut(x["c"], F.get(x["p"], F.size(a)), F.length(t))))

    # text and edits are bound, so that neither expression is repeated in the plan
    return let(F.struct(text.alias("t"), edits.alias("d")), lambda x: let(ordered(x["d"]), lambda a: F.when(
        x["t"].isNull() | (F.size(a) <= 0), x["t"]).when(
        F.exists(a, lambda e: e["s"] > F.length(x["t"])), _replayed(x["t"], x["d"])).otherwise(written(x["t"], a))))


def _replayed(text: Column, edits: Column) -> Column:
    ordered = F.array_sort(
        edits,
        lambda l, r: F.when(l["span_start"] > r["span_start"], F.lit(-1))
        .when(l["span_start"] < r["span_start"], F.lit(1))
        .when(l["ord"] < r["ord"], F.lit(-1))
        .when(l["ord"] > r["ord"], F.lit(1))
        .otherwise(F.lit(0)),
    )
    return F.aggregate(
        ordered,
        text,
        lambda acc, e: F.concat(
            F.substr(acc, F.lit(1), F.greatest(e["span_start"], F.lit(0))),
            e["replacement"],
            F.substr(acc, F.greatest(e["span_end"], F.lit(0)) + 1),
        ),
    )


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Python `text[start:end]` for non-negative offsets."""
    return F.when(end > start, F.substr(text, start + 1, end - start)).otherwise(F.lit(""))
