"""Operator 13: secrets in whole texts.

Base patterns (leftmost non-overlapping matches of each kind; the span is the whole match):

    assign  (password|passwd|secret|token|api_?key) in either case, quote, spaces, `:` or `=`,
            spaces, quote, then a value of 6 or more of [A-Za-z0-9+/_.=-]
    access  AKIA[A-Z0-9]+ of 20 or more characters
    hex     [0-9a-f]+ of 24 or more characters

Method: password guess cost.  Every value in a credential context (a wider set of names, `is` and
`=>` as well, any value of 6 or more bytes without spaces, quotes or brackets) gets the cost in bits of its cheapest
segmentation, found by one dynamic programme from left to right:

    word    rank of a dictionary word, letter case, 1 bit per look-alike digit or sign
    date    year, or day, month and year with or without separators
    repeat  characters equal to those 1 to 8 places before: 4 bits, then 1/4 bit each
    walk    neighbouring keys, or consecutive letters or digits: start, each turn, 1/2 bit a step
    brute   any other character at the logarithm of its class's size

Each segment but brute force costs one bit more, as it must be told apart.  A value of `min_bits` or
more that no base span holds is added as a span of kind `guess` (the value alone, without marks at
its end); values of letters only are taken for words.

The dictionary is learned: the `dictionary` most frequent words of letters in all texts, after a few
passwords everybody tries first; it has a fixed size and goes to the tasks.  Texts are scanned where
they lie, nothing but word counts is shuffled.

Edge cases: null and empty texts have no spans; rows are independent (ties, repeated and null ids
need no rule); an empty table gives no rows; texts and values of any length are read whole; columns
besides id and text are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm.collocations import most_frequent, numbered
from clausewise.llm.common import table, text_slices

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # equal to the runs of 24 or more
CONTEXT = re.compile(rb"""(?:(?:passw(?:or)?d|passphrase|passcode|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key
                            |(?<![a-z])(?:pass|pin|auth|login))["']?(?:[\x20\t]*(?:=>|[:=])[\x20\t]*|[\x20\t]+is[\x20\t]+)
                          |(?<![a-z])bearer[\x20\t]+)["']?([^\s"'<>,;(){}\[\]]{6,})""", re.I | re.X)
NAMED = tuple(b"pass pwd secret token credential key pin auth login bearer".split())  # one is in every assign or context
DICTIONARY = 20_000
MIN_BITS = 30.0

# Passwords that are tried first.
FIRST_TRIED = ("password", "admin", "welcome", "letmein", "login", "master", "monkey", "dragon", "sunshine", "princess", "shadow", "football",
               "secret", "changeme", "default", "test", "guest", "root", "user", "example")
# Digits and signs that stand for letters.
LOOKALIKE = {"4": "a", "@": "a", "3": "e", "0": "o", "5": "s", "$": "s", "7": "t", "1": "i", "!": "i"}
# The keyboard's rows, without and with shift.
ROWS = (("`1234567890-=", "~!@#$%^&*()_+"), ("qwertyuiop[]\\", "QWERTYUIOP{}|"), ("asdfghjkl;'", 'ASDFGHJKL:"'), ("zxcvbnm,./", "ZXCVBNM<>?"))

KEY = {c: (r, i, shift) for r, row in enumerate(ROWS) for shift, line in enumerate(row) for i, c in enumerate(line)}
CHOICE = 1.0                       # that a segment is no brute force
KEY_START, TURN, STEP = math.log2(47), math.log2(6), 0.5
REPEAT, COPY, PERIODS = 3.0, 0.25, 8
YEAR, DAY = math.log2(200), math.log2(366 * 200)

DATES = [(re.compile(p), bits) for p, bits in [
    (r"(?=((?:19|20)\d\d))", YEAR),
    (r"(?=((?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])))", DAY),
    (r"(?=((?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d))", DAY),
    (r"(?=((?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:19|20)\d\d))", DAY),
    (r"(?=((?:19|20)\d\d[-/._](?:0?[1-9]|1[0-2])[-/._](?:0[1-9]|[12]\d|3[01])))", DAY + 2),
    (r"(?=((?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|[12]\d|3[01])[-/._](?:19|20)\d\d))", DAY + 2),
]]


def brute_bits(c: str) -> float:
    if c in "0123456789":
        return math.log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    return math.log2(33) if c < "\x7f" else math.log2(100)


def case_bits(word: str) -> float:
    """Choices of letter case: none, first letter or all, or any pattern."""
    upper = sum(c.isupper() for c in word)
    if upper == 0:
        return 0.0
    if word.isupper() or (upper == 1 and word[0].isupper()):
        return 1.0
    letters = sum(c.isalpha() for c in word)
    few = min(upper, letters - upper)
    return math.log2(sum(math.comb(letters, i) for i in range(1, few + 1)) + 1)


def key_step(a: str, b: str) -> tuple | None:
    """Direction between neighbouring keys (rows lean to the right downwards)."""
    if a not in KEY or b not in KEY:
        return None
    down, right = KEY[b][0] - KEY[a][0], KEY[b][1] - KEY[a][1]
    return (down, right) if (down, right) in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)) else None


def line_step(a: str, b: str) -> int | None:
    """+1 or -1 between consecutive digits or letters of one case."""
    same = a.isascii() and b.isascii() and a.isalnum() and b.isalnum() and (a.isdigit(), a.isupper()) == (b.isdigit(), b.isupper())
    return ord(b) - ord(a) if same and abs(ord(b) - ord(a)) == 1 else None


class GuessCost:
    """Cheapest segmentation of values, given words in the order of trial."""

    def __init__(self, words: list[str]):
        self.automaton = ahocorasick.Automaton()
        for rank, word in enumerate(words, 1):
            if word not in self.automaton:
                self.automaton.add_word(word, (len(word), math.log2(rank + 1)))
        self.automaton.make_automaton()
        self.any = len(self.automaton) > 0

    def words(self, value: str) -> list[tuple[int, int, float]]:
        """(start, end, bits) of dictionary words, look-alikes read as letters."""
        if not self.any:
            return []
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = "".join(LOOKALIKE.get(c, c) for c in lower)
        out = []
        for line in {lower, plain, plain.replace("i", "l") if "1" in lower else plain}:
            for last, (size, bits) in self.automaton.iter(line):
                start = last + 1 - size
                swapped = sum(x != y for x, y in zip(lower[start:last + 1], line[start:last + 1], strict=True))
                out.append((start, last + 1, bits + case_bits(value[start:last + 1]) + swapped))
        return out

    def bits(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """(least bits, its segments (kind, start, end))."""
        n = len(value)
        ending: dict[int, list[tuple[int, float, str]]] = {}
        for start, end, cost in self.words(value):
            ending.setdefault(end, []).append((start, cost, "word"))
        for pattern, cost in DATES:
            for m in pattern.finditer(value):
                ending.setdefault(m.end(1), []).append((m.start(), cost, "date"))
        best, via = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
        # segments in progress, as (bits, start): a walk of keys, a line of letters or digits, copies of each period
        none = (math.inf, 0)
        walk, line, copies = none, none, [none] * (PERIODS + 1)
        way = step = None
        for i in range(1, n + 1):
            c = value[i - 1]
            options = [(best[i - 1] + brute_bits(c), i - 1, "brute")]
            options += [(best[s] + CHOICE + cost, s, kind) for s, cost, kind in ending.get(i, ())]
            if i > 1:
                b = value[i - 2]
                last_way, way = way, key_step(b, c)
                if way is None:
                    walk = none
                else:
                    shifted = KEY[c][2]
                    go = walk[0] + (STEP if way == last_way else TURN) + shifted
                    walk = min((go, walk[1]), (best[i - 2] + CHOICE + KEY_START + TURN + shifted + KEY[b][2], i - 2))
                    options.append((*walk, "walk"))
                last_step, step = step, line_step(b, c)
                if step is None:
                    line = none
                else:
                    go = line[0] + STEP if step == last_step else math.inf
                    line = min((go, line[1]), (best[i - 2] + CHOICE + brute_bits(b) + 1 + STEP, i - 2))
                    options.append((*line, "walk"))
            for p in range(1, min(PERIODS, i - 1) + 1):
                if value[i - 1 - p] == c:
                    copies[p] = min((copies[p][0] + COPY, copies[p][1]), (best[i - 1] + CHOICE + REPEAT + COPY, i - 1))
                    options.append((*copies[p], "repeat"))
                else:
                    copies[p] = none
            best[i], start, kind = min(options)
            via[i] = (kind, start)
        segments, i = [], n
        while i > 0:
            kind, start = via[i]
            if segments and kind == segments[-1][0] == "brute":
                segments[-1] = ("brute", start, segments[-1][2])
            else:
                segments.append((kind, start, i))
            i = start
        return best[n], segments[::-1]


def code_points(raw: bytes, places: list[int]) -> np.ndarray:
    """Code points before each byte offset."""
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.searchsorted(lead, places)


def find(raw: bytes, cost: GuessCost, min_bits: float) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits of the value) of one text, by start and kind."""
    spans: list[tuple[int, int, int, float | None]] = []
    value = lambda a, b: cost.bits(raw[a:b].decode("utf-8", "replace"))[0]
    lower = raw.lower()
    named = any(name in lower for name in NAMED)
    for m in ASSIGN.finditer(raw) if named else ():
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end(), value(*m.span(2))))
    spans += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(raw) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end(), None) for m in HEX.finditer(raw)]
    base = [(s, e) for s, _, e, _ in spans]
    for m in CONTEXT.finditer(raw) if named else ():
        start = m.start(1)
        end = start + len(m.group(1).rstrip(b".:!?*"))
        if end - start >= 6 and not raw[start:end].decode("utf-8", "replace").isalpha() and not any(s <= start and end <= e for s, e in base):
            bits = value(start, end)
            if bits >= min_bits:
                spans.append((start, 3, end, bits))
    spans.sort(key=lambda s: s[:3])
    if not spans:
        return []
    at = code_points(raw, [x for s in spans for x in (s[0], s[2])]).tolist()
    return [(KINDS[s[1]], at[2 * i], at[2 * i + 1], s[3]) for i, s in enumerate(spans)]


def common_words(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 20 letters of all texts (`size` at
    most), most frequent first."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in text_slices(batch.column(0)):
                words, counts, _ = numbered(data, off)
                letters = pc.match_substring_regex(words, r"^\p{L}{3,20}$") if len(words) else pa.array([], pa.bool_())
                yield pa.RecordBatch.from_arrays([words.filter(letters), pa.array(counts, pa.int64()).filter(letters)], ["word", "n"])

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("f")).filter(F.col("f") > 1)
    return [r["word"] for r in sorted(most_frequent(counted, size), key=lambda r: (-r["f"], r["word"]))]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None,
                 min_bits: float = MIN_BITS) -> DataFrame:
    """doc_id (as given), spans array<struct<kind, start, end, bits>>; `words`
    (in the order of trial) replaces the learned dictionary."""
    tried = [*FIRST_TRIED, *(common_words(docs, text_col) if words is None else words)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("bits", T.DoubleType())])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("spans", T.ArrayType(span, False))])
    kind = pa.list_(pa.field("element", pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(tried)
        for batch in batches:
            for a, b, data, off in text_slices(batch.column(1)):
                raw = data.tobytes()
                found = [[dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in find(raw[x:y], cost, min_bits)]
                         for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, schema)


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), number("guess").alias("n_guess"))
