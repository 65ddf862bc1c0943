"""Operator 4: language identification by nearest centroid.

Features: byte 1- to 3-grams of the lower-cased text (ASCII other than letters
reads as a space) hashed to DIMS places, 1 + log counts times inverse document
frequency, scaled to unit length.  Document frequencies are counted over all
training documents; centroids (spherical k-means, several per language) are
fitted on a bounded sample: the SAMPLE documents of each language with the
smallest hash of id and text, repeated rows once.  Centroids of a few odd documents (junk,
documents of another language) are left out.  A text gets the language of the centroid with
the largest cosine.

Rejection is by distance: the cosine is divided by the median that sampled documents of the
language reach at that length.  A text is `rejected` if this is under the language's cut, halfway
between a low quantile of its own documents and a high one of the other languages' documents, and less
for short texts, whose cosines vary; so are
null texts and texts without letters, which are `und`.

The model (DIMS weights and a few centroids per language) is bounded and
shipped with the tasks.  Languages are the label set: one row each.

Edge cases: null and letterless text: `und`, score 0; without labelled
documents all texts are `und`; equal cosines go to the language first in code
point order; rows that repeat are predicted alike; whole texts of any length
are used; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm.common import SLICE_BYTES, mix64, positional, restored, table, text_slices

DIMS = 4096
SAMPLE = 500          # training documents per language for the centroids
CENTROIDS = 4         # per language
ROUNDS = 10           # of k-means
SUPPORT = 0.05        # least share of a language's sample behind a centroid
TAIL = 0.01           # quantiles of own and, from above, of other documents between which the cut lies
CLASSES = 64          # of lengths, two per doubling
SHORT = 100           # grams at which a text's cut is half that of a long one

_LOWEST, _SPAN = -(1 << 63), (1 << 64) - 1  # of 64-bit hashes

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)


def gram_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts rows x DIMS) for runs of rows."""
    lower = pc.utf8_lower(texts)
    for a, b, data, off in text_slices(lower, SLICE_BYTES // 2):
        for c in range(a, b, 256):  # bounds the count matrix
            d = min(b, c + 256)
            lo, hi = off[c - a], off[d - a]
            byte = _FOLD[data[lo:hi]].astype(np.uint64)
            n, row = len(byte), np.repeat(np.arange(d - c), np.diff(off[c - a:d - a + 1]))
            counts = np.zeros((d - c) * DIMS, np.float32)
            code = np.zeros(n, np.uint64)
            for size in (1, 2, 3):
                if n < size:
                    break
                code = (code[:n - size + 1] << np.uint64(8)) | byte[size - 1:]
                at = np.flatnonzero(row[:n - size + 1] == row[size - 1:])
                low = code[at] & np.uint64(0xFFFF)
                at = at[(low != 0x2020) & (code[at] != 0x20)]  # runs of spaces say nothing
                with np.errstate(over="ignore"):
                    place = (mix64(code[at] + np.uint64(size << 32)) >> np.uint64(52)).astype(np.int64)
                counts += np.bincount(row[at] * DIMS + place, minlength=len(counts)).astype(np.float32)
            yield c, d, counts.reshape(d - c, DIMS)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(2 * np.log2(counts.sum(axis=1, dtype=np.float64) + 1)).astype(np.int64), CLASSES - 1)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit rows.  Starts: the row in the middle by cosine with the mean, then
    rows far from all, but nearer than the SUPPORT farthest; centroids with
    fewer rows than that are left out."""
    starts = [int(np.argsort(x @ x.mean(axis=0), kind="stable")[len(x) // 2])]
    for _ in range(1, min(k, len(x))):
        starts.append(int(np.argsort((x @ x[starts].T).max(axis=1), kind="stable")[int(SUPPORT * len(x))]))
    c = x[starts]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    return c[size >= min(size.max(), max(2, SUPPORT * len(x)))]


def typical_cosines(cosine: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Median cosine of each length class and its neighbours; classes without rows lie on
    the line between their neighbours, shorter ones fall with the root of the length."""
    median = np.full(CLASSES, np.nan)
    for s in range(CLASSES):
        near = np.abs(size - s) <= 1
        if near.sum() >= min(8, len(size)):
            median[s] = np.median(cosine[near])
    known = np.flatnonzero(~np.isnan(median))
    if not len(known):
        return np.full(CLASSES, np.median(cosine))
    out = np.interp(np.arange(CLASSES), known, median[known])
    short = np.arange(known[0])
    out[short] *= 2.0 ** ((short - known[0]) / 4)
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(train: DataFrame) -> dict | None:
    """Model from (doc_id, text, lang) rows with lang; None without any."""
    train = train.filter(has_letter(F.col("text"))).withColumn("h", F.xxhash64(F.lit(4), "doc_id", "text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, _, counts in gram_counts(batch.column(0)):
                df += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], ["place", "n"])

    parts = train.select("text").mapInArrow(frequencies, "place int, n long")
    total = {r["place"]: r["n"] for r in parts.groupBy("place").agg(F.sum("n").alias("n")).collect()}  # DIMS + 1 rows
    n_docs = total.pop(-1, 0)
    if not n_docs:
        return None
    df = np.array([total.get(i, 0) for i in range(DIMS)], float)
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1

    # the SAMPLE smallest hashes of each language: by the number of its hashes a range with some more, a cut inside
    # it, then a scan up to the cut
    def under(limits: dict[str, int]) -> Column:
        within = F.lit(False)
        for lang, h in limits.items():
            within = within | ((F.col("lang") == lang) & (F.col("h") <= h))
        return within

    sizes = train.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row per language
    few = train.select("lang", "h").filter(under({r["lang"]: _LOWEST + min(_SPAN, _SPAN * 4 * SAMPLE // max(1, r["n"])) for r in sizes})).distinct()
    first = Window.partitionBy("lang").orderBy("h")
    ranked = few.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLE)
    cut = {r["lang"]: r["cut"] for r in ranked.groupBy("lang").agg(F.max("h").alias("cut")).collect()}  # one row per language

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, counts in gram_counts(batch.column(1)):
                v = tfidf(counts, idf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(length_class(counts), pa.int64()),
                     pa.array([r.astype(np.float16).tobytes() for r in v], pa.binary())], ["lang", "h", "size", "v"])

    rows = train.filter(under(cut)).select("lang", "text", "h").dropDuplicates(["lang", "h"])
    rows = rows.mapInArrow(vectors, "lang string, h long, size long, v binary").toArrow()  # at most SAMPLE rows of 8 KB per language
    lang, h = np.array(rows["lang"].to_pylist()), rows["h"].to_numpy()
    size = rows["size"].to_numpy()
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["v"].to_pylist()]).astype(np.float32)
    order = np.lexsort((size, h, lang))
    lang, size, x = lang[order], size[order], x[order]
    names, centroids, owner = sorted(set(lang.tolist())), [], []
    for i, name in enumerate(names):
        c = spherical_kmeans(x[lang == name], CENTROIDS)
        centroids.append(c)
        owner += [i] * len(c)
    centroids, owner = np.concatenate(centroids), np.array(owner)
    near = x @ centroids.T
    least = np.zeros((len(names), CLASSES))
    for i, name in enumerate(names):
        cosine, own = near[:, owner == i].max(axis=1), lang == name
        typical = typical_cosines(cosine[own], size[own])
        ratio = cosine / np.maximum(typical[size], 1e-12)
        others = np.quantile(ratio[~own], 1 - TAIL) if (~own).any() else 0.0
        grams = 2.0 ** (np.arange(CLASSES) / 2)
        least[i] = typical * (np.quantile(ratio[own], TAIL) + others) / 2 * grams / (grams + SHORT)  # short texts vary more
    return {"names": names, "idf": idf, "centroids": centroids, "owner": owner, "least": least}


def predict(rows: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """`rows` with _lang, _score and _rejected appended."""
    names = rows.columns
    if model is None:
        return rows.withColumns({"_lang": F.lit("und"), "_score": F.lit(0.0), "_rejected": F.lit(True)})
    labels, at_text = [*model["names"], "und"], names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, centroids = model["owner"], model["centroids"].T
        for batch in batches:
            columns, text = list(batch.columns[:-1]), batch.column(at_text)
            for a, b, counts in gram_counts(text):
                near = tfidf(counts, model["idf"]) @ centroids
                by = np.stack([near[:, owner == i].max(axis=1) for i in range(len(labels) - 1)], axis=1)
                best = np.argmax(by, axis=1)
                score = np.clip(by[np.arange(len(by)), best], 0, 1).astype(float)
                letters = batch.column(len(names)).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.where(letters, best, len(labels) - 1), np.where(letters, score, 0.0)
                far = ~letters | (score < np.append(model["least"], np.zeros((1, CLASSES)), axis=0)[best, length_class(counts)])
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in columns], pa.array(np.array(labels, object)[best], pa.string()), pa.array(score), pa.array(far)],
                    [*names, "_lang", "_score", "_rejected"])

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("_lang string, _score double, _rejected boolean").fields])
    return rows.withColumn("_letters", has_letter(F.col(text_col))).mapInArrow(run, schema)


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, Column]:
    """(rows to learn from, whether a document is held out)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    held_out = F.pmod(F.crc32(key), F.lit(4)) == 2
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out.alias("held_out"))
    return rows.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang"), held_out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected.  Learns from documents with
    a language whose crc32(id as text) mod 4 is not 2; predicts all."""
    train, held_out = _training(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, fit(train)).select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are not rejected; columns stay."""
    rows, key, text, lang = positional(docs, id_col, text_col, lang_col)
    train, _ = _training(rows, key, text, lang)
    return restored(predict(rows, fit(train), text).filter("NOT _rejected"), docs.columns)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
