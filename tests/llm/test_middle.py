"""Operator 11: fill-in-middle against a plain Python version."""

import hashlib
import re

import numpy as np
import pytest

from clausewise.llm import middle

TEXTS = [
    None, "", "a", "é", "one two", "ab" * 40_000, "x<P>y", "x<S", "P>y", "<", "M>tail", "mixed Ünïcode 漢字 123 \U0001f600 end\n\tx",
    "<<S <M", "a<P", ">", "word " * 3000, "\n", "日本語のテキスト", "z" * 7, "no sentinel <p> here", "end<", "S>start", "same", "same",
]


def brute(doc_id, text, seed=1, plain=10, spm=20, marks=middle.SENTINELS):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in marks) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    P, S, M = marks
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), S + s + P + p + M + m
    return n, "psm", len(p), len(m), P + p + S + s + M + m


def frame(spark, rows):
    """Rows with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, "f", 1, "o", 3) for i, t in rows], "doc_id long, text string, form string, n int, output string, h1 int")


@pytest.mark.parametrize("window", [7, 1 << 20])
@pytest.mark.parametrize("options", [{}, {"seed": 9, "plain": 0, "spm": 100}, {"plain": 0, "spm": 0, "marks": ("[pre]", "[s]", "[middle]")}])
def test_slices_match_brute_force(monkeypatch, window, options):
    monkeypatch.setattr(middle, "WINDOW", window)
    texts = [t if window > 7 else (t or "")[:90] for t in TEXTS]
    marks = middle.checked(options.get("marks", middle.SENTINELS))
    for start in (0, 500):
        want = [brute(start + i, t, **options) for i, t in enumerate(texts)]
        raw = [(t or "").encode() for t in texts]
        off = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        digest = [hashlib.sha256(f"{options.get('seed', 1)}:{start + i}".encode()).hexdigest() for i in range(len(texts))]
        h = [np.array([int(d[8 * j:8 * j + 8], 16) for d in digest]) for j in range(4)]
        got = middle.fill(data, off, h, marks, options.get("plain", 10), options.get("spm", 20))
        assert list(zip(*[c.to_pylist() for c in got.values()], strict=True)) == want
        out = [w[4].encode() for w in want]
        form = np.array([middle.FORMS.index(w[1]) for w in want])
        back = middle.gather(np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)]), form, marks)
        assert back.to_pylist() == [t or "" for t in texts]


def test_frames(spark):
    rows = [*enumerate(TEXTS), (None, "no id here"), (2**40, "a long id"), (-3, "negative"), (5, "repeated id")]
    got = middle.restore_middle(middle.fill_in_middle(frame(spark, rows).repartition(3)))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    want = sorted(((i, *brute(i, t), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {"plain", "psm", "spm"} == {w[2] for w in want}
    assert middle.fill_in_middle(frame(spark, [])).count() == 0


def test_string_ids_nulls_and_bad_marks(spark):
    docs = spark.createDataFrame([("a", "some text here"), (None, None)], "key string, body string")
    got = middle.fill_in_middle(docs, "key", "body")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", *brute("a", "some text here")), (None, *brute(None, None))], key=repr)
    lost = spark.createDataFrame([("psm", None), ("plain", "x"), (None, "y")], "form string, output string")
    assert {tuple(r) for r in middle.restore_middle(lost).collect()} == {("psm", None, None), ("plain", "x", "x"), (None, "y", "y")}
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "x", "y")):
        with pytest.raises(ValueError):
            middle.checked(bad)
