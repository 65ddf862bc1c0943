"""Operator 1: passages that repeat across documents, by sparse suffix arrays.

Retained suffixes: those at minimisers.  Of every window of `min_words - k + 1`
consecutive k-word grams the one with the smallest hash is kept, so each passage of
`min_words` words keeps at least one suffix, at the same place in every
document that holds the passage.

Comparing neighbours: suffixes that are equal over their first k words are
neighbours in suffix order.  Only those that meet a neighbour from another text remain
(most texts end here).  Extending: around a remaining suffix, the suffixes that
start up to `min_words - k` words to its left are compared with their
neighbours over `min_words` words.  Each that has an equal neighbour in another
text is a repeated window; overlapping windows of a text join into the longest
passage, so matches extend left and right word by word.

Suffixes are compared by 64-bit hashes of their words, so that equal neighbours
meet by combining counts before the shuffle: a passage that a third of all
documents share is one combined row per task, never a list.  Texts of equal words
are compared once and the result goes to every copy.

Result: one row per passage of a document: doc_id, start (word, from 0), n_words,
first_doc_id (the smallest id among the documents that share a window of it),
is_first.  Repeats inside one document only do not count.  `repeated_passages` also
names, in _cut, the first holder of each run of windows inside the passage:
`cut_passages` removes words by window, never those of a window whose first holder
is the document itself, so every repeated window stays in its first holder.

Edge cases: null, empty and short texts (under min_words words) have no
passages; a text of any length is used whole; equal texts are passages from
their first to their last word; a row given twice counts as a copy; ties of
order go to the smaller id; null ids are documents but never the first one unless all
are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import gram_hashes, materialise, mix64, positional, table, text_slices, word_bounds, word_hashes

MIN_WORDS, K = 50, 16


def text_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit key of each row's word sequence (0 without words)."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    if len(full):
        place = np.arange(len(words)) - np.repeat(first[:-1], n)
        with np.errstate(over="ignore"):
            out[full] = mix64(np.add.reduceat(mix64(words + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), first[:-1][full]))
    return out


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for every i with a full window, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[:len(out) - step], out[step:])
        have += step
    return out


def minimisers(grams: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram index) of the grams that are smallest in some window of
    `width` grams of their row."""
    n = len(grams)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    least = _sliding(grams, width, np.minimum)
    least = np.where(row[:len(least)] == row[width - 1:], least, np.uint64(0))  # windows over two rows name nothing
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = _sliding(padded, width, np.maximum)  # over the windows that hold gram i
    index = np.flatnonzero((most == grams) & (most > 0))
    return row[index], index


def _suffixes(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """doc_id, node (key of the words), n_words, kept: array of (gram hash, word)."""
    kept = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column(1)):
                starts, ends, first = word_bounds(data, off)
                words = word_hashes(data, starts, ends)
                grams, at = gram_hashes(words, first, k)
                row, index = minimisers(grams, at, min_words - k + 1)
                n_words = np.diff(first)
                size = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(grams[index].view(np.int64)), pa.array((index - at[row]).astype(np.int32))], ["h", "pos"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(text_keys(words, first).view(np.int64)), pa.array(n_words.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(size), flat).cast(kept)], ["doc_id", "node", "n_words", "kept"])

    return docs.mapInArrow(run, "doc_id long, node long, n_words long, kept array<struct<h:long,pos:int>>")


def _windows(rows: DataFrame, min_words: int, k: int) -> DataFrame:
    """(w, node, rep, s) of the min_words-word suffixes whose minimiser remains;
    rows: doc_id, node, text, pos (array of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column(2)):
                starts, ends, first = word_bounds(data, off)
                words = word_hashes(data, starts, ends)
                part = batch.slice(a, b - a)
                nodes = part.column(1).to_numpy()
                same = text_keys(words, first).view(np.int64) == nodes  # the text that was meant
                small, at_small = gram_hashes(words, first, k)
                grams, at = gram_hashes(words, first, min_words, seed=1)
                got_w, got_node, got_s = [], [], []
                for i in np.flatnonzero(same):
                    mine = small[at_small[i]:at_small[i + 1]]
                    least = _sliding(mine, min_words - k + 1, np.minimum)
                    s = np.flatnonzero(np.isin(least, mine[part.column(3)[int(i)].values.to_numpy()]))
                    got_w.append(grams[at[i] + s].view(np.int64))
                    got_node.append(np.full(len(s), i))
                    got_s.append(s.astype(np.int32))
                if got_w:
                    row = np.concatenate(got_node)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(got_w)), pa.array(nodes[row]), part.column(0).take(pa.array(row)), pa.array(np.concatenate(got_s))],
                        ["w", "node", "rep", "s"])

    return rows.mapInArrow(run, "w long, node long, rep long, s int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """doc_id, start, n_words, first_doc_id, is_first, and _cut for `cut_passages`:
    the text's key, its representative, whether it has copies, min_words, and runs
    (from, to, first) of windows with one first holder."""
    if not 0 < k < min_words:
        raise ValueError("k must be between 1 and min_words - 1")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(_suffixes(base, min_words, k).filter(F.col("n_words") >= min_words), "passages-suffixes")
    texts = materialise(found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_words").alias("n_words")), "passages-texts")
    one = found.alias("f").join(texts.alias("t"), F.expr("f.node = t.node AND f.doc_id <=> t.rep")).select("f.node", F.explode("kept").alias("x"))
    one = one.select("node", F.col("x.h").alias("h"), F.col("x.pos").alias("pos"))
    # equal neighbours from another text
    met = one.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("h")
    met = materialise(met, "passages-met")  # written, so that a hot suffix can be split in the join
    places = one.join(met, "h").groupBy("node").agg(F.collect_set("pos").alias("pos"))
    places = materialise(places.join(texts.select("node", "rep"), "node"), "passages-places")
    # a merge join at every size: texts are the large side, and the plan stays the same as tables grow
    text = base.alias("b").join(places.alias("p").hint("merge"), F.expr("b.doc_id <=> p.rep")).select("b.doc_id", "p.node", "b.text", "p.pos")
    windows = materialise(_windows(text, min_words, k), "passages-windows")
    # equal neighbours from another text, and the first document among them
    shared = windows.groupBy("w").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("rep").alias("first")).filter("lo <> hi")
    reps = texts.select("node", "rep", "copies", "n_words")
    shared = materialise(shared, "passages-shared")
    starts = windows.select("w", "node", "s").join(shared.select("w", "first"), "w").select("node", "s", "first")
    by_text = Window.partitionBy("node").orderBy("s")
    so_far = by_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap, before = F.col("s") - F.lag("s").over(by_text), F.lag("first").over(by_text)
    starts = starts.withColumn("new", (gap > min_words).cast("int")).withColumn("turn", (~((gap == 1) & before.eqNullSafe(F.col("first")))).cast("int"))
    starts = starts.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(so_far)).withColumn("part", F.sum(F.coalesce("turn", F.lit(0))).over(so_far))
    runs = starts.groupBy("node", "run", "part").agg(F.min("s").alias("from"), F.max("s").alias("to"), F.min("first").alias("first"))
    spans = runs.groupBy("node", "run").agg(
        F.min("from").alias("start"), (F.max("to") - F.min("from") + min_words).cast("long").alias("n_words"), F.min("first").alias("first"),
        F.collect_list(F.struct("from", "to", "first")).alias("runs"))
    spans = materialise(spans, "passages-spans")
    # texts with copies are passages as a whole
    held = spans.groupBy("node").agg(F.min("first").alias("first"), F.flatten(F.collect_list("runs")).alias("runs"))
    whole = reps.filter("copies > 1").join(held, "node", "left").select(
        "node", F.lit(0).alias("start"), "n_words", F.least("rep", "first").alias("first"), "rep", F.lit(True).alias("copied"), "runs")
    parts = spans.join(reps.filter("copies = 1").select("node", "rep"), "node").select(
        "node", "start", "n_words", "first", "rep", F.lit(False).alias("copied"), "runs")
    out = found.select("doc_id", "node").join(whole.unionByName(parts), "node")
    return out.select("doc_id", F.col("start").cast("long").alias("start"), "n_words", F.col("first").alias("first_doc_id"),
                      F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False)).alias("is_first"),
                      F.struct("node", "rep", "copied", F.lit(min_words).alias("min_words"), "runs").alias("_cut"))


def _dropped(doc_id, n: int, cuts: list[dict]) -> np.ndarray:
    """Which of a document's n words go: those of windows that another document
    holds first, without those of windows that this one holds first."""
    drop, keep = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for cut in cuts:
        if cut["copied"] and doc_id != cut["rep"]:
            return np.ones(n, bool)
        width, other = cut["min_words"], np.zeros(n - cut["min_words"] + 1, bool)
        for run in cut["runs"] or ():
            mine = run["first"] is None or run["first"] == doc_id
            to = keep if mine else drop
            to[run["from"]] += 1
            to[run["to"] + width] -= 1
            other[run["from"]:run["to"] + 1] = True
        if cut["copied"]:  # the other windows are in copies of this text only
            at = np.flatnonzero(~other)
            keep[at] += 1
            keep[at + width] -= 1
    return (np.cumsum(drop)[:n] > 0) & (np.cumsum(keep)[:n] == 0)


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the passages that are not first: their words go, the rest
    of the text stays as it is, and so does each repeated window in its first
    holder.  `passages` is the result of `repeated_passages`.  Columns and rows stay."""
    drop = passages.filter("NOT is_first").groupBy("doc_id").agg(F.collect_set("_cut").alias("_cuts"))
    names, schema = docs.columns, docs.schema
    docs, id_col, text_col = positional(docs, id_col, text_col)
    drop = drop.withColumnRenamed("doc_id", "_doc")
    joined = docs.join(drop, F.col(id_col).cast("long").eqNullSafe(F.col("_doc")), "left").select(*docs.columns, F.col(id_col).cast("long").alias("_doc_id"), "_cuts")

    def cut(texts: pa.Array, ids: pa.Array, cuts: pa.Array) -> list[str | None]:
        out = []
        for text, doc_id, spans in zip(texts.to_pylist(), ids.to_pylist(), cuts.to_pylist(), strict=True):
            if text is not None and spans:
                raw = text.encode()
                starts, ends, first = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                key = int(text_keys(word_hashes(np.frombuffer(raw, np.uint8), starts, ends), first).view(np.int64)[0])
                gone = np.concatenate([[0], _dropped(doc_id, len(starts), [s for s in spans if s["node"] == key]), [0]])
                edge = np.diff(gone.astype(np.int8))
                kept, at = [], 0
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    kept.append(raw[at:starts[a]])
                    at = int(ends[b - 1])
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        return out

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(cut(cols[at], batch.column(len(names)), batch.column(len(names) + 1)), pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, schema)


def op1_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("_cut")


# Every 50-word window of every text; equal windows in two documents; islands.
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, unnest(generate_series(0, len(words) - 50)) AS s, words FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(words[s + 1:s + 50], ' ')) AS gram FROM g),
r AS (SELECT gram, min(doc_id) AS first FROM h GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT h.doc_id, h.s, r.first FROM h JOIN r USING (gram)),
y AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 50 THEN 1 ELSE 0 END AS new FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM y)
SELECT doc_id, min(s) AS start, max(s) - min(s) + 50 AS n_words, min(first) AS first_doc_id, doc_id = min(first) AS is_first
FROM z GROUP BY doc_id, run
"""
