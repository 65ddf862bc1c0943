"""Edits, slices, suggestions and chunks of long documents: equal to plain
Python, and in time that grows with the document."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from clausewise.functions.text import apply_edits, cut, slice_cut
from clausewise.operators.drift import chunk_table
from clausewise.operators.pii import pii_violations, redact
from clausewise.operators.rewrite import suggestions
from clausewise.functions.violations import VIOLATION_TYPE, number, violation

ALPHABET = "ab é漢\U0001f600\n"


def edited(text, edits):
    for s, e, r, _ in sorted(edits, key=lambda x: (-x[0], x[3])):
        text = text[:max(s, 0)] + r + text[max(e, 0):]
    return text


def test_edits_equal_the_sequential_rule(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 9, 60, 4095, 4097, 6000])))
        n, edits = len(text), []
        for k in range(rng.choice([0, 1, 2, 5, 12, 40])):
            s = rng.randint(-2, n + (3 if i % 4 == 0 else 0))
            edits.append((s, s + rng.choice([0, 1, 3, 30, 700, -2]), rng.choice(["", "X", "yy漢", "long replacement " * 4]), k))
        rows.append((i, text if i else None, edits))
    df = spark.createDataFrame(rows, "i int, text string, edits array<struct<span_start:int,span_end:int,replacement:string,ord:int>>")
    got = {r.i: r.out for r in df.select("i", apply_edits(F.col("text"), F.col("edits")).alias("out")).collect()}
    assert got == {i: None if t is None else edited(t, e) for i, t, e in rows}


def test_slices_of_cut_texts(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(ALPHABET) for _ in range(9000))
    places = [(rng.randint(0, 9100), rng.randint(0, 9100)) for _ in range(200)] + [(0, 9000), (512, 512), (511, 513), (0, 0), (8999, 9000)]
    for t in (text, text[:100], ""):
        df = spark.createDataFrame([(t, places)], "t string, p array<struct<s:int,e:int>>").withColumn("c", cut(F.col("t")))
        got = df.select(F.transform("p", lambda p: slice_cut(F.col("c"), p["s"], p["e"])).alias("x")).first().x
        assert got == [t[s:e] for s, e in places]


def test_suggestions_redact_the_spans_they_meet(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh é") for _ in range(5000))
    spans = [("pii", s, s + rng.choice([1, 4, 30, 400])) for s in (rng.randrange(4990) for _ in range(60))]
    others = [("rule", s, min(5000, s + rng.choice([0, 10, 900]))) for s in (rng.randrange(5000) for _ in range(40))] + [("rule", 0, 5000)] * 2
    every = spans + others
    rng.shuffle(every)
    df = spark.createDataFrame([(text, every)], "text string, v array<struct<t:string,s:int,e:int>>")
    typed = F.transform("v", lambda v: violation(scanner=v["t"], type=v["t"], span_start=v["s"], span_end=v["e"], severity="low", text=v["t"]))
    got = df.select(suggestions(F.col("text"), number(typed)).alias("s")).first().s
    pii = [(s, e) for t, s, e in every if t == "pii"]
    for (kind, a, b), one in zip(every, got, strict=True):
        piece = text[a:b]
        if kind == "rule":
            edits = [(max(s, a) - a, min(e, b) - a) for s, e in pii]
            edits = [(s, e, f"[REDACTED_{hashlib.sha256(piece[s:e].encode()).hexdigest()[:8]}]", k) for k, (s, e) in enumerate(edits) if s < e]
            assert one.original_text == piece and one.replacement == edited(piece, edits) + " [COMPLIANCE FIX APPLIED]"
        else:
            assert one.replacement == "[REDACTED]"
    assert len(VIOLATION_TYPE.fields) > 5


def seconds(df):
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def grows_with_its_input(run, small, large):
    run(small)  # code is compiled
    a, b = min(run(small) for _ in range(2)), min(run(large) for _ in range(2))
    assert b <= 3.0 * a + 0.5, (a, b)  # twice the document


def test_time_of_long_documents(spark):
    def overlapping(n):
        text = "".join(f"mail{i}@b.example and 4111111111111{i % 1000:03} " for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        return seconds(df.select(redact(F.col("text"), pii_violations(F.col("text")))))
    grows_with_its_input(overlapping, 2000, 4000)

    def chunked(n):
        text = "\n\n".join(f"Clause {i} on the berth and its ropes, lanterns and bells, number {i * 7919 % 1000}." for i in range(n))
        return seconds(chunk_table(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    grows_with_its_input(chunked, 4000, 8000)


def test_chunks_start_where_their_text_first_stands(spark):
    rng = random.Random(6)
    base = [f"paragraph {i} " + "".join(rng.choice("abc é漢") for _ in range(60)).strip() + "." for i in range(90)]
    parts = base + [base[3]] * 5 + ["in front of " + base[7] + " and behind it", base[7], "x" * 70, "x" * 60, "  " + base[11] + "\t"]
    rng.shuffle(parts)
    texts = ["\n\n".join(parts), "\n\n".join(parts[:20]), "", None, "\n\n\n\n" + "\n\n \n\n".join(parts * 3), "a" * 60 + "\n\n" + "a" * 55]
    for sep in ("\n\n", "\n", "a"):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = [(r.doc_id, r.chunk_index, r.span_start, r.span_end) for r in chunk_table(df, sep=sep).orderBy("doc_id", "chunk_index").collect()]
        want = []
        for i, t in enumerate(texts):
            kept = [p.strip() for p in (t or "").split(sep) if len(p.strip()) > 50]
            want += [(i, k, t.find(c), t.find(c) + len(c)) for k, c in enumerate(kept)]
        assert got == want
