"""Operator 11: fill-in-middle transformation of whole texts.

A text of n units (a run of ASCII letters, or one other code point) is cut at two places drawn
from its id; its form (plain, psm or spm) is drawn from the id too:

    h1 .. h4   first four 8-digit groups of sha256("<seed>:<id>"), as unsigned integers
    prefix     ends after min(h1 % (n+1), h2 % (n+1)) units, the middle after the larger one
    plain      empty text, a text that holds a sentinel, or h3 % 100 >= 100 - plain_percent
    spm        of the others, those with h4 % 100 < spm_percent;  psm: the rest

    psm = <P>prefix<S>suffix<M>middle        spm = <S>suffix<P>prefix<M>middle

Method: displacement scatter.  The bytes of a batch are scanned once for unit starts; each part
of each text enters a difference array with the change of its output shift, the cumulative
sum gives every byte its shift, and one numpy scatter builds all outputs of the batch.
`restore_middle` finds the sentinels and gathers the bytes back by the same sums.  Work goes by
windows of bounded size inside one text as well, so index arrays do not grow with a text.

Edge cases: null and empty texts are plain with an empty output; a null id draws from
"<seed>:"; equal ids draw equally, rows are independent (ties, repeats and empty tables need no
rule); texts of any length are cut whole; columns besides id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm.common import table, text_slices

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
FORMS = ("plain", "psm", "spm")
WINDOW = 1 << 20  # bytes whose index arrays are held at once

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def checked(sentinels: tuple[str, str, str]) -> list[bytes]:
    """Sentinels as bytes.  None may start inside another, so that a sentinel
    never arises from a text's end and a sentinel's begin."""
    marks = [s.encode() for s in sentinels]
    if len(set(marks)) < 3 or any(m[:1] == n[i:i + 1] for m in marks for n in marks for i in range(1, len(n))) or not all(marks):
        raise ValueError("sentinels must differ and hold the first byte of a sentinel at their start only")
    return marks


def scan(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit starts, code point starts) as masks with one place more than `data`."""
    points, units = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    points[:-1] = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    units[:-1] = points[:-1]
    units[1:-1] &= ~(letter[1:] & letter[:-1])
    units[off[:-1]] = points[off[:-1]]  # a text starts a unit
    units[-1] = points[-1] = False
    return units, points


def sums(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Set places of `mask` in each range [start, end); ranges ascend."""
    out = np.zeros(len(start), np.int64)
    full = np.flatnonzero(end > start)
    if len(full):
        bounds = np.column_stack([start[full], end[full]]).ravel()
        out[full] = np.add.reduceat(mask, bounds, dtype=np.int64)[::2]
    return out


def places(mask: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Byte of the wanted-th set place (from 0), window by window."""
    out, seen = np.zeros(len(wanted), np.int64), 0
    for a in range(0, len(mask), WINDOW):
        found = np.flatnonzero(mask[a:a + WINDOW])
        here = (wanted >= seen) & (wanted < seen + len(found))
        out[here] = a + found[wanted[here] - seen]
        seen += len(found)
    return out


def shifts(start: np.ndarray, shift: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, shift of each byte) by windows, for parts that begin at
    the ascending `start`: the cumulative sum of their differences."""
    change = np.diff(shift, prepend=0)
    carry = 0
    for a in range(0, size, WINDOW):
        b = min(a + WINDOW, size)
        difference = np.zeros(b - a, np.int64)
        lo, hi = np.searchsorted(start, [a, b])
        np.add.at(difference, start[lo:hi] - a, change[lo:hi])
        difference[0] += carry
        total = np.cumsum(difference)
        carry = total[-1]
        yield a, b, total


def hits(raw: bytes, marks: list[bytes], off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, byte, which mark) of the marks inside texts, in byte order."""
    found = [(m.start(), marks.index(m.group())) for m in re.finditer(b"|".join(map(re.escape, marks)), raw)]
    at = np.array([f[0] for f in found], np.int64)
    which = np.array([f[1] for f in found], np.int64)
    row = np.searchsorted(off, at, side="right") - 1
    size = np.array([len(m) for m in marks])[which]
    inside = at + size <= off[row + 1]  # bytes of two texts make no mark
    return row[inside], at[inside], which[inside]


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data))


def layout(form: np.ndarray, begin: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray,
           marks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Output bytes at which prefix, middle and suffix (columns) of each text
    begin, where `begin` is the output's first byte."""
    p, s, m = map(len, marks)
    psm, spm = form == 1, form == 2
    to_prefix = begin + np.where(psm, p, np.where(spm, s + suffix + p, 0))
    to_suffix = begin + np.where(psm, p + prefix + s, np.where(spm, s, prefix + middle))
    to_middle = begin + np.where(form > 0, p + s + m + prefix + suffix, prefix)
    return to_prefix, to_middle, to_suffix


def fill(data: np.ndarray, off: np.ndarray, h: list[np.ndarray], marks: list[bytes], plain: int, spm: int) -> dict:
    """The transformation of one slice of texts."""
    units, points = scan(data, off)
    begin, end = off[:-1], off[1:]
    n = sums(units, begin, end)
    form = np.where(h[3] % 100 < spm, 2, 1)
    form[(h[2] % 100 >= 100 - plain) | (n == 0)] = 0
    form[hits(data.tobytes(), marks, off)[0]] = 0
    x, y = h[0] % (n + 1), h[1] % (n + 1)
    first = np.cumsum(n) - n  # units before each text
    cuts = []
    for k in (np.minimum(x, y), np.maximum(x, y)):
        at = end.copy()
        inner = np.flatnonzero(k < n)
        at[inner] = places(units, first[inner] + k[inner])
        cuts.append(at)
    c1, c2 = cuts
    out_off = np.zeros(len(off), np.int64)
    np.cumsum(end - begin + np.where(form > 0, sum(map(len, marks)), 0), out=out_off[1:])
    to_prefix, to_middle, to_suffix = layout(form, out_off[:-1], c1 - begin, c2 - c1, end - c2, marks)
    out = np.empty(out_off[-1], np.uint8)
    start = np.column_stack([begin, c1, c2]).ravel()
    shift = np.column_stack([to_prefix - begin, to_middle - c1, to_suffix - c2]).ravel()
    for a, b, by in shifts(start, shift, len(data)):
        out[np.arange(a, b) + by] = data[a:b]
    cut = form > 0
    for mark, to in zip(marks, (to_prefix, to_suffix, to_middle), strict=True):
        for i, byte in enumerate(mark):
            out[to[cut] - len(mark) + i] = byte
    none = pa.array(form == 0)
    return {"n": pa.array(n), "form": pa.array(np.array(FORMS, object)[form], pa.string()),
            "prefix_chars": pa.array(sums(points, begin, c1), mask=none.to_numpy(False)),
            "middle_chars": pa.array(sums(points, c1, c2), mask=none.to_numpy(False)),
            "output": strings(out, out_off)}


def gather(data: np.ndarray, off: np.ndarray, form: np.ndarray, marks: list[bytes]) -> pa.Array:
    """Texts of one slice of outputs, from outputs and forms alone."""
    begin, end = off[:-1], off[1:]
    at = np.full((3, len(form)), -1, np.int64)
    row, place, which = hits(data.tobytes(), marks, off)
    at[which, row] = place
    p, s, m = (at[i] + len(mark) for i, mark in enumerate(marks))  # first bytes of the parts
    cut = form > 0
    if (at[:, cut] < 0).any():
        raise ValueError("an output without its three sentinels")
    p = np.where(cut, p, begin)
    prefix = np.where(form == 1, at[1], np.where(form == 2, at[2], end)) - p
    middle = np.where(cut, end - m, 0)
    suffix = np.where(form == 1, at[2], np.where(form == 2, at[0], 0)) - np.where(cut, s, 0)
    text_off = np.zeros(len(off), np.int64)
    np.cumsum(prefix + middle + suffix, out=text_off[1:])
    t = text_off[:-1]
    start = np.column_stack([t, t + prefix, t + prefix + middle]).ravel()
    source = np.column_stack([p, np.where(cut, m, end), np.where(cut, s, end)]).ravel()
    text = np.empty(text_off[-1], np.uint8)
    for a, b, by in shifts(start, source - start, len(text)):
        text[a:b] = data[np.arange(a, b) + by]
    return strings(text, text_off)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10,
                   spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id (as given), n, form, prefix_chars, middle_chars (null if plain), output."""
    marks = checked(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest.alias("digest"))
            .select("doc_id", "text", *drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(4)]
            for a, b, data, off in text_slices(batch.column(1)):
                got = fill(data, off, [x[a:b] for x in h], marks, plain_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *got.values()], ["doc_id", *got])

    fields = [rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
              T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields))


def restore_middle(filled: DataFrame, output_col: str = "output", form_col: str = "form", into: str = "restored",
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """`filled` with one more column, the text rebuilt from output and form
    (null for a null output)."""
    marks = checked(sentinels)
    output, form_at = filled.columns.index(output_col), filled.columns.index(form_col)
    named = filled.toDF(*[f"c{i}" for i in range(len(filled.columns))])
    schema = T.StructType([*named.schema, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = np.array([FORMS.index(f or "plain") for f in batch.column(form_at).to_pylist()], np.int64)
            for a, b, data, off in text_slices(batch.column(output)):
                text = gather(data, off, np.where(np.diff(off) > 0, form[a:b], 0), marks)
                part = batch.slice(a, b - a)
                lost = part.column(output).is_null()
                if lost.null_count < len(lost) and pa.compute.any(lost).as_py():
                    text = pa.compute.if_else(lost, pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([*part.columns, text], schema.names)

    return named.mapInArrow(run, schema).toDF(*filled.columns, into)


def op11_middle(spark, sf_dir: str) -> DataFrame:
    both = restore_middle(fill_in_middle(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH unit AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents),
drawn AS (
    SELECT *, len(u) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
           ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
    FROM unit),
cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
part AS (
    SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
           coalesce(array_to_string(u[b + 1:n], ''), '') AS s
    FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM part
"""
