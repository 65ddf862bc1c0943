"""Operators 1 and 8 against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clausewise.llm import jaccard
from clausewise.llm.components import components
from clausewise.llm.jaccard import keep_first, similarity_classes
from clausewise.llm.passages import cut_passages, repeated_passages

SCHEMA = "doc_id long, text string, class_id string, node int, start string, h int, n int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "c", 1, "s", 2, 3) for i, t in docs], SCHEMA)


def words(text):
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text or "") if w]


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(docs, threshold=0.8):
    sets = [shingles(t) for _, t in docs]
    link = [[j for j in range(len(docs)) if j != i and sets[i] and sets[j]
             and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-6] for i in range(len(docs))]
    root = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            root[i] = min([root[i], *(root[j] for j in link[i])])
    least = {}
    for i, r in enumerate(root):
        if docs[i][0] is not None:
            least[r] = min(least.get(r, docs[i][0]), docs[i][0])
    out = []
    for i, (d, _) in enumerate(docs):
        out.append((d, least.get(root[i], d), len(link[i]), len({frozenset(sets[j]) for j in link[i] if sets[j] != sets[i]})))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 60, 200]))) for _ in range(n // 3)]
    for i in range(n):
        w = words(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append((i, " ".join(w)))
    return docs


EDGES = [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "one  two"), (905, "x " * 3000), (906, "x " * 2500),
         (907, "é ü ñ ç ß"), (907, "é ü ñ ç ß"), (908, "ab cd e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    docs = corpus(seed) + EDGES
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in similarity_classes(frame(spark, docs)).collect())
    assert got == sorted(brute_classes(docs))


def test_large_group_of_near_copies(spark, monkeypatch):
    # one group above the bucket and block sizes: split, chunked and compared in block pairs
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rnd = random.Random(7)
    base = [f"t{i}" for i in range(300)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(300)] = f"u{i}"
        docs.append((i, " ".join(w)))
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in similarity_classes(frame(spark, docs)).collect())
    assert got == sorted(brute_classes(docs))


def children(monkeypatch):
    """(rows, row count) lists of the split buckets, filled as they are written."""
    got, write = [], jaccard.materialise

    def kept(df, name):
        out = write(df, name)
        if name == "path-kids":
            got.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", kept)
    return got


def test_children_of_a_growing_group(spark, monkeypatch):
    # a group of near copies is not split: each set would go to all children of its paths
    monkeypatch.setattr(jaccard, "SMALL", 8)
    made = children(monkeypatch)
    base = [f"t{i}" for i in range(300)]
    for n in (60, 240):
        docs = [(i, " ".join(base[:i % 300] + [f"u{i}"] + base[i % 300 + 1:])) for i in range(n)]
        got = sorted((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in similarity_classes(frame(spark, docs)).collect())
        assert got == sorted(brute_classes(docs))
        assert made.pop() <= n * len(jaccard.root_tokens(0.8, jaccard.runs_for(0.9995)))


def test_large_buckets_of_a_common_passage(spark, monkeypatch):
    # buckets that share a passage but are not similar: split by what they agree on, pairs kept
    monkeypatch.setattr(jaccard, "SMALL", 8)
    made = children(monkeypatch)
    rnd = random.Random(11)
    common, docs = [f"c{i}" for i in range(50)], []
    for i in range(0, 400, 2):
        w = common + [f"v{rnd.randrange(10**6)}" for _ in range(rnd.choice([60, 150]))]
        docs.append((i, " ".join(w)))
        docs.append((i + 1, " ".join(w[:-4] + [f"x{i}"] * 4 if i % 4 else rnd.sample(w, len(w)))))
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in similarity_classes(frame(spark, docs)).collect())
    assert got == sorted(brute_classes(docs)) and sum(r[2] for r in got) >= 200
    roots, paths = len(jaccard.root_tokens(0.8, jaccard.runs_for(0.9995))), jaccard.paths_for(0.8, jaccard.TOKENS, 0.9995)
    assert 0 < made.pop() <= len(docs) * roots * paths


def test_threshold_itself_counts(spark):
    # 9 and 11 shingles, 9 shared... 8 of 10: exactly 0.8
    a = " ".join(f"a{i}" for i in range(12))  # 8 shingles
    b = a + " b0 b1"                            # 10 shingles, 8 shared
    c = a + " b0 b1 b2"                         # 11 shingles: 8 / 11 with a
    rows = {r.doc_id: r for r in similarity_classes(frame(spark, [(1, a), (2, b), (3, c)])).collect()}
    assert rows[1].n_links == 1 and rows[2].n_links == 2 and rows[3].n_links == 1
    assert {r.class_id for r in rows.values()} == {1}


def test_keep_first_keeps_one_of_each_class(spark):
    docs = corpus(3) + [(None, "null id text of seven words here"), (None, "another null id text of words here"), (5000, None)] + EDGES
    df = frame(spark, docs)
    kept = keep_first(df)
    assert kept.columns == df.columns
    groups = {}
    for (d, c, _, _), (_, t) in zip(brute_classes([(i, t) for i, (_, t) in enumerate(docs)]), docs):
        groups.setdefault(c, set()).add(t)
    got = [r.text for r in kept.collect()]
    rows = {}
    for t in got:
        if words(t):
            rows[frozenset(shingles(t))] = rows.get(frozenset(shingles(t)), 0) + 1
    assert all(n == 1 for n in rows.values())
    for texts in groups.values():
        if any(words(t) for t in texts):
            assert sum(t in texts for t in got) == 1


def test_empty_tables(spark):
    empty = frame(spark, [(1, "x")]).filter("doc_id = 2")
    assert similarity_classes(empty).count() == 0 and repeated_passages(empty).count() == 0 and keep_first(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert got == want


def brute_passages(docs, n=50):
    where = {}
    for at, (_, t) in enumerate(docs):
        w = words(t)
        for s in range(len(w) - n + 1):
            where.setdefault(tuple(w[s:s + n]), set()).add(at)
    out = []
    for at, (d, t) in enumerate(docs):
        w, runs = words(t), []
        for s in range(len(w) - n + 1):
            owners = where[tuple(w[s:s + n])]
            if len(owners) > 1:
                first = min(docs[o][0] for o in owners)
                if runs and s - runs[-1][1] <= n:
                    runs[-1][1], runs[-1][2] = s, min(runs[-1][2], first)
                else:
                    runs.append([s, s, first])
        out += [(d, a, b - a + n, f, d == f) for a, b, f in runs]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 80, 140)]
    docs = []
    for i in range(40):
        w = text(rnd.choice([0, 20, 120]))
        for _ in range(rnd.randrange(3)):
            w += rnd.choice(shared) + text(rnd.choice([0, 1, 30, 60]))
        docs.append((i, " ".join(w)))
    docs += [(70, docs[3][1]), (71, None), (72, ""), (73, "a " * 400), (74, " ".join(shared[0])), (75, " ".join(shared[0]) + " tail")]
    got = sorted((r.doc_id, r.start, r.n_words, r.first_doc_id, r.is_first) for r in repeated_passages(frame(spark, docs)).collect())
    assert got == brute_passages(docs)


def test_cut_leaves_one_copy_and_the_rest_of_the_text(spark):
    p = " ".join(f"p{i}" for i in range(60))
    docs = [(1, f"alpha\n{p} omega"), (2, f"beta  {p}\tend"), (3, "clean text"), (4, None)]
    df = frame(spark, docs)
    out = {r.doc_id: r.text for r in cut_passages(df, repeated_passages(df)).collect()}
    assert out == {1: docs[0][1], 2: "beta  \tend", 3: "clean text", 4: None}


def windows(docs, n=50):
    """The documents (places) that hold each n-word window."""
    where = {}
    for at, (_, t) in enumerate(docs):
        w = words(t)
        for s in range(len(w) - n + 1):
            where.setdefault(tuple(w[s:s + n]), set()).add(at)
    return where


def test_cut_keeps_each_repeated_window_somewhere(spark):
    rnd = random.Random(4)
    text = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    p, q, own = text(60), text(70), text(500)
    docs = [(1, text(30) + p + text(20)), (2, text(10) + q), (5, own + p), (6, own + p),         # copies with a passage of document 1
            (7, p + q + text(9)), (8, text(5) + p + q), (9, p + text(20) + q), (10, q + text(3) + p)]  # passages that touch
    docs += [(11, x) for x in (text(80) + q, text(60))] + [(12, docs[0][1]), (13, text(90))]     # one id with two texts
    r = text(70)
    docs += [(None, r + text(4)), (None, r), (None, docs[1][1]), (13, docs[-1][1])]
    shared = [text(n) for n in (50, 60, 75, 120)]
    for i in range(30):
        docs.append((100 + i, [w for _ in range(3) for w in rnd.choice(shared) + text(rnd.choice([0, 1, 30]))]))
    docs += [(200 + i, docs[-1 - i][1]) for i in range(4)]
    docs = [(i, " ".join(w)) for i, w in docs]
    df = frame(spark, docs).coalesce(1)
    out = cut_passages(df, repeated_passages(df)).collect()
    cut = [(r.doc_id, r.text) for r in out]
    before, after = windows(docs), windows(cut)
    assert {w for w, held in before.items() if len(held) > 1} <= set(after)
    assert {w for _, t in docs for w in words(t)} == {w for _, t in cut for w in words(t)}
    five = next(t for i, t in cut if i == 5)
    assert words(five)[:500] == own and len(words(five)) < 560 and not words(next(t for i, t in cut if i == 6))
    want = []
    for i, t in docs:
        w, drop, keep = words(t), set(), set()
        for s in range(len(w) - 49):
            held = before[tuple(w[s:s + 50])]
            if len(held) > 1:
                first = min((docs[at][0] for at in held if docs[at][0] is not None), default=None)
                (keep if first in (i, None) else drop).update(range(s, s + 50))
        want.append((i, [x for at, x in enumerate(w) if at not in drop - keep]))
    key = lambda x: (str(x[0]), x[1])
    assert sorted(want, key=key) == sorted(((i, words(t)) for i, t in cut), key=key)
    eleven = sorted(len(words(t)) for i, t in cut if i == 11)
    assert eleven == [60, 80]  # the other text of the id is not touched


def test_repeats_inside_one_document_do_not_count(spark):
    p = " ".join(f"p{i}" for i in range(60))
    assert repeated_passages(frame(spark, [(1, f"{p} {p}"), (2, "other")])).count() == 0
    same = repeated_passages(frame(spark, [(1, p), (1, p)])).collect()  # a row given twice is a copy
    assert [(r.start, r.n_words) for r in same] == [(0, 60)] * 2
    assert repeated_passages(frame(spark, [(1, p)]).select("doc_id", F.col("text"))).count() == 0
