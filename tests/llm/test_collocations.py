"""Operator 12: collocations against a plain Python version."""

import re
from collections import Counter

import numpy as np
import pytest

from clausewise.llm import collocations as C


def brute(rows, min_count, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if a >= min_count and len(k) > 2}
    out = []
    for (lang, *w), a in cand.items():
        if any(q[0] == lang and len(q) - 1 > len(w) and b >= a and any(list(q[1 + i:1 + i + len(w)]) == w for i in range(len(q) - len(w)))
               for q, b in cand.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(ranked)


def corpus(n=300):
    rng = np.random.default_rng(4)
    vocab = {"en": ["The", "of", "New", "York", "city", "und", "a", "I"], "fr": ["é", "la", "Ville", "de", "New", "York"], None: ["x", "y"], "und": ["x", "z"]}
    rows = []
    for i in range(n):
        lang = list(vocab)[int(rng.integers(4)) if i % 3 else 0]
        words = rng.choice(vocab[lang], size=int(rng.integers(0, 40)), p=None).tolist()
        seps = rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ;", " "], size=len(words), p=[.6, .1, .05, .05, .05, .05, .05, .05]).tolist()
        rows.append((lang, "".join(w + s for w, s in zip(words, seps, strict=True))))
    return [*rows, ("en", None), ("fr", ""), ("en", "a a a a a a a a a a"), ("en", " \t.,;"), ("de", "once only"),
            ("en", "New York " * 200 + "w" * 90 + " " + "w" * 90), *[("es", "uno dos tres cuatro cinco seis")] * 9]


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, "k", 1, 2, "p") for lang, t in rows], "lang string, text string, key string, f int, words int, phrase string")


@pytest.mark.parametrize("max_ids", [C.MAX_IDS, 9, 0])
def test_matches_brute_force(spark, max_ids):
    rows = corpus()
    for min_count, longest, top in ((6, 5, 2000), (9, 3, 4)):
        got = C.collocations(frame(spark, rows).repartition(3), min_count=min_count, longest=longest, top=top, max_ids=max_ids)
        assert sorted(map(tuple, got.collect())) == brute(rows, min_count, longest, top)


def test_small_tiles_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 2)
    monkeypatch.setattr(C, "DENSE", 3)
    key, n = C.count_pairs(np.array([0, 0, 0, 5, 1, 0, 7]), np.array([1, 1, 0, 4, 1, 1, 9]))
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == {1: 3, 0: 1, 1 << 32 | 1: 1, 5 << 32 | 4: 1, 7 << 32 | 9: 1}


def test_long_words_are_counted_by_their_text(spark):
    long = "q" * 100
    rows = [("en", f"{long} of the {long}")] * 8
    got = C.collocations(frame(spark, rows), min_count=6)
    assert sorted(map(tuple, got.collect())) == brute(rows, 6)


def test_scores_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("cast(17000000000000 as decimal(19,0)) a", "cast(20000000000000 as decimal(19,0)) n", "cast(17000000000001 as decimal(19,0)) l")
    got = row.selectExpr("cast(1000 as decimal(4,0)) * a * n as above", "l * l as below").selectExpr("cast(above div below as long) s").first().s
    assert got == 1000 * 17000000000000 * 20000000000000 // 17000000000001**2


def test_empty_and_nothing_frequent(spark):
    assert C.collocations(frame(spark, [])).count() == 0
    got = C.collocations(frame(spark, [("en", "only a few words"), (None, None)]))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
