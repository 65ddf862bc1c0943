"""Operators 4 and 10: held-out accuracy, exact targets, reruns."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.llm import langid, mixing
from clausewise.llm.common import table

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, size string, shard int, score string, _lang int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, "y", 2) for i, t, lang, s in rows], SCHEMA)


def fill(sizes, share=1.5, cap=2.0, cycle=(5, 2, 1)):
    """Targets by clamping round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {n: cycle[i % 3] for i, n in enumerate(names)}
    target, left, todo = {}, share * sum(sizes.values()), set(names)
    while todo:
        level = left / sum(weight[n] for n in todo)
        over = {n for n in todo if level * weight[n] > cap * sizes[n]}
        if not over:
            return target | {n: level * weight[n] for n in todo}
        for n in over:
            target[n] = cap * sizes[n]
            left -= target[n]
        todo -= over
    return target


def check(spark, rows, **params):
    docs, draws = mixing.mix_plan(frame(spark, rows), **params)
    got = collections.Counter((r.doc_id, r.h) for r in draws.collect())
    size = lambda t: len((t or "").split())
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = fill(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    by_id = {r[0]: r for r in rows}
    plan = docs.collect()
    assert len(plan) == len(rows)
    for r in plan:
        src = by_id[r.doc_id][3]
        assert r.size == size(by_id[r.doc_id][1]) and abs(r.target - want[src]) < 1e-6 * max(1, want[src])
        assert 0 <= r.copies <= 2
        assert r.copies == got[(r.doc_id, r.h)] // sum(1 for x in plan if (x.doc_id, x.h) == (r.doc_id, r.h))
        taken[src] += r.copies * r.size
        largest[src] = max(largest[src], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], (s, taken[s], want[s])
    return plan


def test_targets_and_draws(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), None, [None, "a", "b", "c", "d"][min(4, int(rng.exponential(1.2)))]) for i in range(700)]
    check(spark, rows, block_docs=16, n_shards=7)
    check(spark, rows, block_docs=1000, n_shards=1)


def test_mix_edge_rows(spark):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "w " * 20000, None, "b"), (4, "x y", None, "b"), (5, "z", None, None), (6, "q r", None, "hot")]
    check(spark, rows)
    assert mixing.mix(frame(spark, rows).filter("doc_id = 99")).count() == 0
    assert mixing.mix_plan(frame(spark, [(1, None, None, "a"), (2, "", None, "b")]))[1].count() == 0  # no words at all


def test_mix_rows_agree_with_plan_and_reruns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 9)), "en", f"s{i % 4 if i % 3 else 0}") for i in range(300)]
    df = frame(spark, rows)
    one, two = mixing.mix(df, n_shards=5, block_docs=8), mixing.mix(df, n_shards=5, block_docs=8)
    assert one.columns == df.columns
    count = lambda d: collections.Counter(r.doc_id for r in d.collect())
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(df, n_shards=5, block_docs=8)[0].collect() if r.copies}
    assert count(one) == count(two) == plan


def test_quotas_split_exactly(spark):
    cuts = spark.createDataFrame([("a", 1000), ("b", 3), (None, 77)], "src string, blocks long")
    spans = mixing._splits(cuts, 9, 5).collect()
    for src, n in (("a", 1000), ("b", 3), (None, 77)):
        at = sorted((r["first"], r["quota"]) for r in spans if r["src"] == src)
        assert at[0][0] == 0 and sum(q for _, q in at) == n
        assert all(a + q == b for (a, q), (b, _) in zip(at, at[1:]))
    per = collections.Counter()
    for r in spans:
        per[r["shard"]] += r["quota"]
    assert max(per.values()) - min(per.values()) <= 1


def test_op10_registered(spark):
    rows = mixing.op10_mixture(spark, SF).collect()
    docs = table(spark, SF, "documents").collect()
    assert len(rows) == len(docs) and all(0 <= r.taken <= 2 * r["size"] for r in rows)


def test_taken_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 7), None, "abc"[i % 3]) for i in range(90)]
    rows += [(5, "same words here", None, "c")] * 3 + [(None, "x y z", None, s) for s in "aabbbc"] + [(None, "x y z", None, None)] * 2
    df = frame(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan = mixing.mix_plan(df)[0].collect()
    want = collections.Counter((r.doc_id, r["size"], r.source_size, r.copies * r["size"]) for r in plan)
    got = mixing.op10_mixture(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in got) == want
    assert len(got) == len(rows) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    mixed = collections.Counter((r.source, r.doc_id) for r in mixing.mix(df).collect())
    copies = collections.Counter()
    for r in plan:
        copies[(r.src, r.doc_id)] += r.copies
    assert mixed == +copies and any(r.copies == 2 and r.doc_id is None for r in plan)


def test_null_ids_with_different_texts_meet_the_target(spark, tmp_path):
    rows = [(None, f"a b c d e t{i}", None, "s") for i in range(400)] + [(i, "x y " * 500, None, "t") for i in range(40)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in mixing.op10_mixture(spark, str(tmp_path)).collect() if r.doc_id is None]
    target, taken = got[0].target, sum(r.taken for r in got)
    assert len(got) == 400 and abs(taken - target) <= 6 and {r.taken for r in got} <= {0, 6, 12}


def test_shards_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 10)
    monkeypatch.setattr(mixing, "LEAST_SHARDS", 2)
    df = frame(spark, [(i, "w " * 5, None, "ab"[i % 2]) for i in range(60)])
    mixed = mixing.mix(df, block_docs=4)
    assert mixed.rdd.getNumPartitions() == 45  # 300 words, 450 of them drawn
    assert sum(1 for p in mixed.rdd.glom().map(len).collect() if p) > 20


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in langid.op4_langid(spark, MORE).collect()}
    docs = table(spark, MORE, "documents").select("doc_id", "lang", "text").collect()
    held = [d for d in docs if got[d.doc_id].held_out]
    assert len(got) == len(docs) and len(held) > 150
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    import zlib
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    good = {r.doc_id for r in table(spark, MORE, "labels").filter("quality = 1").collect()}
    assert sum(r.rejected for r in got.values()) <= 0.02 * len(docs)  # junk too
    assert sum(got[i].rejected for i in good) <= 0.01 * len(good)     # clean documents stay


@pytest.mark.parametrize("withheld", ["de", "en", "es", "fr"])
def test_an_unknown_language_is_rejected(spark, withheld):
    docs = table(spark, MORE, "documents").select("doc_id", "text", F.when(F.col("lang") != withheld, F.col("lang")).alias("lang"))
    good = table(spark, MORE, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("good"))
    truth = table(spark, MORE, "documents").select("doc_id", F.col("lang").alias("truth"))
    rows = langid.identify(docs).join(truth, "doc_id").join(good, "doc_id", "left").collect()
    strange = [r.rejected for r in rows if r.truth == withheld]
    known = [r.rejected for r in rows if r.held_out and r.good and r.truth != withheld]
    assert np.mean(strange) >= 0.8 and np.mean(known) <= 0.01, (np.mean(strange), np.mean(known))


def test_typical_cosines_and_supported_centroids():
    size = np.array([10] * 20 + [20] * 20)
    typical = langid.typical_cosines(np.array([0.4] * 20 + [0.8] * 20), size)
    assert typical[10] == 0.4 and typical[20] == 0.8 and 0.4 < typical[15] < 0.8 and typical[63] == 0.8 and 0 < typical[2] < typical[5] < 0.4
    rng = np.random.default_rng(1)
    x = np.abs(np.concatenate([rng.normal([1, 0, 0], 0.05, (50, 3)), rng.normal([0, 1, 0], 0.05, (50, 3)), [[0, 0, 1]]]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.spherical_kmeans(x, 4)
    assert (c @ [1, 0, 0]).max() > 0.95 and (c @ [0, 1, 0]).max() > 0.95 and (c @ [0, 0, 1]).max() < 0.5  # one odd row has none
    assert len(langid.spherical_kmeans(x[:1], 4)) == 1


def test_language_edge_rows(spark):
    train = [(i, "the cat and the dog of the house " * 3, "en", "s") for i in range(20)]
    train += [(100 + i, "der hund und die katze aus dem haus " * 3, "de", "s") for i in range(20)]
    odd = [(200, None, "en", "s"), (201, "", "de", "s"), (202, "123 !!! $$$", None, "s"), (203, "und der hund", None, "s"),
           (204, "the dog " * 30000, None, "s"), (204, "the dog " * 30000, None, "s"), (None, "the cat", "en", "s"), (205, "漢字かな", None, "s")]
    df = frame(spark, train + odd)
    got = collections.defaultdict(list)
    for r in langid.identify(df).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 and got[i][0].rejected for i in (200, 201, 202))
    assert got[203][0].lang_pred == "de" and [r.lang_pred for r in got[204]] == ["en", "en"]
    assert got[205][0].lang_pred in ("de", "en") and got[205][0].rejected and got[None][0].held_out is not None
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {200, 201, 202, 205}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.identify(df.filter("doc_id = -1")).count() == 0
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
