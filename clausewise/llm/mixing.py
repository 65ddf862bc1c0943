"""Operator 10: mixing sources to target weights.

Targets: each source gets `total_share` of all words by its weight, at most
`max_repeats` times its own words; the excess goes to the others by weight
until none is above (water-filling, closed form over the sources sorted by
cap / weight).

Selection: documents of a source stand in the order of a keyed 63-bit hash.  A
source repeats whole passes and takes a part of one more pass: the documents
whose cumulated words stay nearest to the rest of the target.  The cut is found
like a radix select: sums of 4,096 hash ranges per source, then 4,096 ranges
of the range with the cut, then the documents of that one (a 2^-24 part of
the source), so no task ever sees a whole source.

Order: a source's passes are cut into blocks (equal hash ranges).  Exact block
quotas go down a splitting tree over the output shards: at each node the left
half's share of every source is one multivariate hypergeometric draw, seeded
by the node, so each shard walks its own path from the root and knows its
quotas and offsets without any global state.  A shard holds disjoint ranges of
the permuted blocks of each source and is shuffled locally by a keyed hash.

Only per-source rows (one per source: the mixture's configuration) go through a
single task or a broadcast-sized join side.

Edge cases: null text has size 0; a null source is a source of its own, last;
a source without words has target 0 and is not taken; documents of size 0
weigh nothing and follow their hash like others; null and repeated ids are told apart by
their texts, rows that repeat id, text and source share a hash and are taken or left
together; an empty table gives no rows; extra columns are ignored by `mix_plan` and kept by
`mix`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import materialise, words_expr

RADIX_BITS = 12
TOP, LOW = 63 - RADIX_BITS, 63 - 2 * RADIX_BITS
STRIDE = 2_654_435_761  # prime above any block count: i * STRIDE mod q permutes q blocks


def cycle_weights(weights: tuple[int, ...] = (5, 2, 1)) -> Column:
    """Weight of the i-th source (from 0), repeating."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))


def targets(sizes: DataFrame, total_share: float = 1.5, max_repeats: float = 2.0,
            weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(src, size) -> one row per source: src, n_docs, source_size, weight, target."""
    per = sizes.groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # sources are the mixture's configuration: one row each, so a single window is fine
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    per = per.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("weight", cycle_weights(weights))
    cap = F.col("source_size") * F.lit(max_repeats)
    fill = Window.orderBy(cap / F.col("weight"), F.col("_rank"))
    per = (per.withColumn("_cap", cap)
           .withColumn("_before", F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)))
           .withColumn("_open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
           .withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * F.lit(total_share)))
    level = (F.col("_all") - F.coalesce(F.col("_before"), F.lit(0.0))) / F.col("_open")
    # the first source (in fill order) whose share is within its cap fixes the level
    per = per.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("_cap"))
    per = per.withColumn("_final", F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("weight"), F.col("_cap")))
    return per.select("src", "n_docs", "source_size", "weight", target.cast("double").alias("target"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    size = words_expr(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("src"), size.alias("size"),
        _hash(id_col, text_col, seed).alias("h"))


#: Per-source rows are broadcast only up to this many sources (checked).
BROADCAST_SOURCES = 100_000


def _small(per_source: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(per_source) if n_sources <= BROADCAST_SOURCES else per_source


def _cuts(sizes: DataFrame, per: DataFrame, n_sources: int) -> DataFrame:
    """One row per source: whole passes, the rest of the target, and the hash
    range (2 * RADIX_BITS bits) in which the cumulated words reach the rest."""
    base = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    per = per.withColumn("passes", F.when(F.col("source_size") > 0, base).otherwise(0))
    per = per.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    coarse = sizes.groupBy("src", F.shiftright("h", TOP).alias("hi")).agg(F.sum("size").alias("s"))
    run = Window.partitionBy("src").orderBy("hi").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coarse = coarse.withColumn("cum", F.sum("s").over(run))
    at = per.alias("p").join(coarse.alias("c"), F.expr("p.src <=> c.src AND c.cum > p.rest"))
    # min over (hi, words before it): one row per source
    at = at.groupBy("p.src").agg(F.min(F.struct("hi", (F.col("cum") - F.col("s")).alias("before"))).alias("m"))
    at = at.select("src", F.col("m.hi").alias("hi"), F.col("m.before").alias("before"))
    per = per.alias("p").join(at.alias("a"), F.expr("p.src <=> a.src"), "left").select("p.*", "hi", "before")
    inner = sizes.alias("s").join(_small(per.select("src", "hi", "rest", "before"), n_sources).alias("p"),
                                  F.expr(f"s.src <=> p.src AND shiftright(s.h, {TOP}) = p.hi"))
    fine = inner.groupBy("p.src", F.shiftright("h", LOW).alias("lo")).agg(
        F.sum("size").alias("s"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = Window.partitionBy("src").orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = fine.withColumn("cum", F.col("before") + F.sum("s").over(run)).filter("cum > rest")
    fine = fine.groupBy("src").agg(F.min(F.struct("lo", (F.col("cum") - F.col("s")).alias("before"))).alias("m"))
    fine = fine.select("src", F.col("m.lo").alias("lo"), F.col("m.before").alias("lo_before"))
    return per.drop("hi", "before").alias("p").join(fine.alias("f"), F.expr("p.src <=> f.src"), "left").select("p.*", "lo", "lo_before")


def _last_hash(sizes: DataFrame, cuts: DataFrame, n_sources: int) -> DataFrame:
    """`cuts` with cut_h: documents with h below it are in the last, partial
    pass (nearest cumulated words; at most one document off)."""
    edge = sizes.alias("s").join(_small(cuts.select("src", "lo", "lo_before", "rest"), n_sources).alias("c"),
                                 F.expr(f"s.src <=> c.src AND shiftright(s.h, {LOW}) = c.lo"))
    edge = edge.groupBy("c.src", "h").agg(F.sum("size").alias("s"), F.first("lo_before").alias("b"), F.first("rest").alias("rest"))
    run = Window.partitionBy("src").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("cum", F.col("b") + F.sum("s").over(run)).filter("cum - s / 2 <= rest")
    top = edge.groupBy("src").agg((F.max("h") + 1).alias("cut"))
    out = cuts.alias("c").join(top.alias("t"), F.expr("c.src <=> t.src"), "left").select("c.*", "cut")
    # no document of the edge range fits: cut at the range; no edge (rest never reached): everything
    return out.withColumn("cut_h", F.when(F.col("rest") <= 0, F.lit(0).cast("long")).otherwise(
        F.coalesce(F.col("cut"), F.shiftleft(F.col("lo"), LOW), F.lit((1 << 63) - 1))))


def _splits(cuts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(src, shard, first, quota): ranges of permuted blocks by the splitting tree."""
    rows = cuts.select("src", "blocks").orderBy(F.col("src").asc_nulls_last()).collect()  # one row per source
    names, counts = [r["src"] for r in rows], np.array([r["blocks"] for r in rows], np.int64)

    def walk(batches):
        total = int(counts.sum())
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                lo, hi, left, off = 0, n_shards, counts.copy(), np.zeros(len(counts), np.int64)
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    room = total * mid // n_shards - total * lo // n_shards
                    rng = np.random.default_rng([seed, lo, hi])
                    took = rng.multivariate_hypergeometric(left, room, method="marginals") if room else np.zeros_like(left)
                    if shard < mid:
                        hi, left = mid, took
                    else:
                        lo, off, left = mid, off + took, left - took
                at = np.flatnonzero(left)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in at], pa.string()), pa.array(np.full(len(at), shard), pa.int32()),
                     pa.array(off[at], pa.int64()), pa.array(left[at], pa.int64())], ["src", "shard", "first", "quota"])

    return cuts.sparkSession.range(n_shards).mapInArrow(walk, "src string, shard int, first long, quota long")


BLOCK = "CASE WHEN bits = 0 THEN 0L ELSE shiftright({h}, 63 - bits) END"


#: Words of a shard (about 128 MB of text), and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 20_000_000, 64


def _configured(sizes: DataFrame, total_share: float, max_repeats: float, weights: tuple[int, ...], n_shards: int | None,
                block_docs: int, seed: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(per source: target, cut and blocks; src, at -> shard; numbers of sources and shards)."""
    per = materialise(targets(sizes, total_share, max_repeats, weights), "mix-targets")
    n_sources, words = per.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    n_shards = n_shards or max(LEAST_SHARDS, int(-(-words // SHARD_WORDS)))
    cuts = _last_hash(sizes, _cuts(sizes, per, n_sources), n_sources)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n_docs") / F.lit(block_docs), F.lit(1.0))))).cast("int")
    cuts = cuts.withColumn("bits", bits).withColumn("width", F.expr("shiftleft(1L, bits)"))
    # blocks drawn: all of each whole pass, and those up to the cut
    part = F.when(F.col("cut_h") > 0, F.expr(BLOCK.format(h="(cut_h - 1)")) + 1).otherwise(0)
    cuts = materialise(cuts.withColumn("blocks", F.col("passes") * F.col("width") + part), "mix-cuts")
    span = _splits(cuts, n_shards, seed).select(F.col("src").alias("b_src"), "shard", F.explode(F.expr("sequence(first, first + quota - 1)")).alias("b_at"))
    return cuts, materialise(span, "mix-span"), n_sources, n_shards  # written: the planner knows the table's size


def _copies(rows: DataFrame, cuts: DataFrame, n_sources: int) -> DataFrame:
    """Rows (with _src, _h) and their source's target, cut and number of copies."""
    c = _small(cuts.select(F.col("src").alias("c_src"), "source_size", "target", "passes", "width", "bits", "blocks", "cut_h"), n_sources)
    return rows.join(c, F.col("_src").eqNullSafe(F.col("c_src"))).withColumn("copies", F.col("passes") + (F.col("_h") < F.col("cut_h")).cast("int"))


def _drawn(copied: DataFrame, span: DataFrame, seed: int) -> DataFrame:
    """One row per copy: _shard, and _place, which orders a shard."""
    rows = copied.filter("copies > 0").withColumn("_pass", F.explode(F.expr("sequence(0, copies - 1)")))
    at = F.expr(f"(_pass * width + {BLOCK.format(h='_h')}) % blocks * ({STRIDE} % blocks) % blocks")
    rows = rows.withColumn("_at", at).join(span, F.expr("_src <=> b_src AND _at = b_at"))
    return rows.withColumn("_shard", F.col("shard")).withColumn("_place", F.xxhash64(F.lit(seed + 1), "_h", "_pass"))


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             total_share: float = 1.5, max_repeats: float = 2.0, weights: tuple[int, ...] = (5, 2, 1),
             n_shards: int | None = None, block_docs: int = 256, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).  documents: src, doc_id, size, source_size, target, copies,
    h - one row per input row.  draws: src, doc_id, h, pass, shard - one row per copy taken."""
    sizes = materialise(_sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    cuts, span, n_sources, _ = _configured(sizes, total_share, max_repeats, weights, n_shards, block_docs, seed)
    copied = _copies(sizes.withColumnRenamed("src", "_src").withColumnRenamed("h", "_h"), cuts, n_sources)
    draws = _drawn(copied, span, seed).select(
        F.col("_src").alias("src"), "doc_id", F.col("_h").alias("h"), F.col("_pass").alias("pass"), F.col("_shard").alias("shard"))
    return copied.select(F.col("_src").alias("src"), "doc_id", "size", "source_size", "target", "copies", F.col("_h").alias("h")), draws


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        total_share: float = 1.5, max_repeats: float = 2.0, weights: tuple[int, ...] = (5, 2, 1),
        n_shards: int | None = None, block_docs: int = 256, seed: int = 20) -> DataFrame:
    """The mixed corpus: the columns of `docs`, a row per copy, dealt by shard
    and shuffled inside it.  Texts move once, to their shard."""
    sizes = materialise(_sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    cuts, span, n_sources, n_shards = _configured(sizes, total_share, max_repeats, weights, n_shards, block_docs, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(source_col).cast("string").alias("_src"), _hash(id_col, text_col, seed).alias("_h"))
    drawn = _drawn(_copies(rows, cuts, n_sources), span, seed).select("_row", "_shard", "_place")
    return drawn.repartitionById(n_shards, "_shard").sortWithinPartitions("_shard", "_place").select("_row.*")


def taken(doc: DataFrame, draws: DataFrame) -> DataFrame:
    """Every document of a plan with the words the mix takes from it.  Rows that
    repeat an id, size and source, null ids too, share their draws: each has as
    many copies as there are draws per draw of the first pass."""
    got = draws.groupBy("src", "doc_id", "h").agg(
        (F.count("*") / F.count(F.when(F.col("pass") == 0, 1))).cast("long").alias("n"), F.min("shard").alias("shard"))
    return (doc.alias("d").join(got.alias("g"), F.expr("d.src <=> g.src AND d.doc_id <=> g.doc_id AND d.h = g.h"), "left")
            .select("d.doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target",
                    (F.coalesce("n", F.lit(0)) * F.col("size")).cast("long").alias("taken"), "shard"))


def op10_mixture(spark, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes from it, counted from the
    draws that the shards received."""
    from clausewise.llm.common import table
    return taken(*mix_plan(table(spark, sf_dir, "documents")))
