"""Operator 12: phrase collocations per language.

Texts are lower-cased (A-Z), split at `.,;:!?` and line ends into pieces and those into words; a
phrase is 2 to 5 words of one piece.  With f its contiguous occurrences (overlaps included) in
the texts of a language, candidates are the phrases with f >= `min_count`.  The score of a cut
after k words is floor(1000 * f * n / (f(first part) * f(rest))), n the words of the language;
the lowest cut counts, ties to the smallest k.  A candidate goes if a longer candidate that
contains it occurs as often (checked one word longer: by counts in between, that is enough).

Method: direct-address tiling.  Texts become blocks of word numbers once (written).  Words that
occur often enough get ids by frequency, each language's from a multiple of `TILE`, so that
adjacent id pairs fall into tiles of TILE x TILE cells: tiles with many pairs are counted by a
dense numpy bincount, the rest as sorted coordinates with run lengths.  Spark sums the cells of
all tasks.  Frequent pairs are ranked again, and neighbours that overlap in all but one word are
the pairs of the next level: a phrase can only be frequent if both of them are.

Dictionaries of ids are sent to the tasks, so a level's holds the `max_ids` most frequent phrases
at most (words of over 64 bytes none).  Only the words' dictionary holds text: a longer phrase is a
pair of ids, and its text is written by the tasks from the words its ids lead to.  If frequent phrases
remain outside, neighbours that are not ranked may still be frequent: their phrases are counted
by their text instead, which is exact at any size but dear.  Sums are partial in every task, so no frequent
word, phrase or language gathers in one task; joins by a frequent part of a phrase are salted.

Edge cases: null text is empty; null language is `und`; documents without words only add nothing;
repeated rows count each time; a language without candidates has no rows; an empty table gives
none; texts of any length are read whole; other columns are ignored.  Counts are 64-bit, scores are
computed in 38-digit decimals.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import materialise, table, text_slices
from clausewise.session import checkpoint_dir

TILE = 1024
DENSE = TILE * TILE // 16   # pairs from which a tile is counted densely
HELD = 500_000              # pairs a task holds before it counts them
MAX_IDS = 4_000_000         # ids of a level's dictionary: 12 bytes each, words with their text
ID_BYTES = 64               # longest word (and language name) in the dictionary
BLOCK = 256_000             # text bytes of a block, one document at least
GROUP_BYTES = 8_000_000     # of blocks read at once
SALT = 8
FREQUENT, MAX_FREQUENT = 1000, 10_000   # parts salted in joins: of so many times `min_count`, and so many at most
NONE, OPEN = -1, -2         # certainly not frequent; not ranked, may be frequent

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_INK = ~_BREAK
_INK[[0x20, 0x09]] = False


def numbered(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, counts, word numbers with -1 between pieces) of a run
    of texts."""
    data = _LOWER[data]
    ink = _INK[data]
    head, tail = ink.copy(), ink.copy()
    head[1:] &= ~ink[:-1]
    tail[:-1] &= ~ink[1:]
    inner = off[(off > 0) & (off < len(data))]  # texts end words
    head[inner], tail[inner - 1] = ink[inner], ink[inner - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    if len(starts) == 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    first = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=first[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(first), pa.py_buffer(data[ink])).dictionary_encode()
    number = words.indices.to_numpy()
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts) + np.searchsorted(off, starts, side="right")
    new = np.flatnonzero(np.diff(piece)) + 1
    ids = np.insert(number, new, -1).astype(np.int32)
    return words.dictionary, np.bincount(number, minlength=len(words.dictionary)), ids


def word_blocks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, words, counts, ids: texts of one language as word numbers, packed
    (see `packed`)."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).dictionary_encode()
            row_lang = code.indices.to_numpy()
            for c in range(len(code.dictionary)):
                texts = batch.column(1).take(pa.array(np.flatnonzero(row_lang == c)))
                for _, _, data, off in text_slices(texts, BLOCK):
                    words, counts, ids = numbered(data, off)
                    if len(ids):
                        yield pa.RecordBatch.from_arrays(
                            [code.dictionary.slice(c, 1), *[pa.array([x], pa.binary()) for x in packed(words, counts, ids)]],
                            ["lang", "words", "counts", "ids"])

    return rows.mapInArrow(run, "lang string, words binary, counts binary, ids binary")


def packed(words: pa.Array, counts: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A block as three buffers: words, each with a line end (no word holds one),
    64-bit counts, and numbers of 16 bits, or 32 if there are more words."""
    text = pc.binary_join_element_wise(words, "", "\n")
    data = b"".join(text.cast(pa.binary()).to_pylist())
    return data, counts.astype(np.int64).tobytes(), ids.astype(np.uint16 if len(words) < 65_535 else np.uint32).tobytes()


def unpacked_words(data: bytes) -> pa.Array:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw == 10)
    off = np.zeros(len(end) + 1, np.int32)
    off[1:] = end - np.arange(len(end))
    return pa.StringArray.from_buffers(len(end), pa.py_buffer(off), pa.py_buffer(raw[raw != 10]))


def unpacked_ids(data: bytes, n_words: int) -> np.ndarray:
    """Word numbers, -1 between pieces."""
    if n_words >= 65_535:
        return np.frombuffer(data, np.int32)
    ids = np.frombuffer(data, np.uint16).astype(np.int32)
    ids[ids == 65_535] = -1
    return ids


def written_blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """`word_blocks` in the shared folder, in row groups of bounded bytes: a
    scan holds one of them at a time."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/word-blocks-{uuid.uuid4().hex}"
    blocks = word_blocks(docs, lang_col, text_col)
    blocks.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words, counts = unpacked_words(batch.column(1)[i].as_py()), pa.array(np.frombuffer(batch.column(2)[i].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(words)), words, counts], ["lang", "phrase", "n"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.frombuffer(c, np.int64).sum()) for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["lang", "n"])


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left << 32 | right, occurrences) of the distinct pairs: dense tiles by
    bincount, the other ones as sorted coordinates."""
    key = left << 32 | right
    wide = int(max(left.max(initial=0), right.max(initial=0))) // TILE + 1
    tile = (left // TILE) * wide + right // TILE
    number, size = np.unique(tile, return_counts=True)
    keys, sums = [], []
    rest = np.ones(len(key), bool)
    for t in number[size >= DENSE]:
        here = tile == t
        rest &= ~here
        cells = np.bincount((left[here] % TILE) * TILE + right[here] % TILE, minlength=TILE * TILE)
        full = np.flatnonzero(cells)
        row, column = t // wide * TILE + full // TILE, t % wide * TILE + full % TILE
        keys.append(row << 32 | column)
        sums.append(cells[full])
    sparse, times = np.unique(key[rest], return_counts=True)
    return np.concatenate([*keys, sparse]), np.concatenate([*sums, times])


# A level holds the ids of the most frequent phrases of one length, in plain values so that it can be sent anywhere:
# "words", per language (words, their ids in a row), or "keys", the ascending id pairs of the level before, with their "ids";
# "open": frequent phrases of this length exist that could have an id and have none;
# "texts": there are some that can't have one (long words, and pairs with a part without an id).

def word_status(level: dict, lang: str, words: pa.Array) -> np.ndarray:
    """Id, NONE or OPEN of each of distinct words."""
    out = np.full(len(words), OPEN if level["open"] else NONE, np.int64)
    if level["texts"]:
        out[pc.greater(pc.binary_length(words), ID_BYTES).to_numpy(zero_copy_only=False) | (len(lang.encode()) > ID_BYTES)] = OPEN
    if lang in level["words"]:
        known, ids = level["words"][lang]
        at = pc.index_in(known, value_set=words)  # the table of a block's words is the smaller one to build
        found = pc.is_valid(at).to_numpy(zero_copy_only=False)
        out[at.drop_null().to_numpy()] = ids[found]
    return out


def pair_status(level: dict, status: np.ndarray) -> np.ndarray:
    """Status of each phrase of this length from that of one word less."""
    left, right, keys = status[:-1], status[1:], level["keys"]
    out = np.full(len(left), NONE, np.int64)
    ranked = (left >= 0) & (right >= 0)
    if level["open"] or level["texts"]:
        out[(left != NONE) & (right != NONE) & (~ranked | level["open"])] = OPEN
    both = np.flatnonzero(ranked)
    key = left[both] << 32 | right[both]
    if len(keys):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found = keys[at] == key
        out[both[found]] = level["ids"][at[found]]
    return out


def counted_by_text(level: dict) -> bool:
    """Whether frequent phrases of this length have no id."""
    return level["open"] or level["texts"]


def longer(blocks: DataFrame, levels: list[dict]) -> DataFrame:
    """key (pair of ids) or lang and phrase, with partial counts n: the
    phrases of one word more than the last level."""
    size = len(levels) + 1
    shared = blocks.sparkSession.sparkContext.broadcast(levels)
    texts = counted_by_text(levels[-1])
    names = ["key", "lang", "phrase", "n"] if texts else ["key", "n"]

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int32)]
        key, n = count_pairs(*[np.concatenate(side or none).astype(np.int64) for side in (held[::2], held[1::2])])
        empty = [pa.nulls(len(key), pa.string())] * 2 if texts else []
        for a in range(0, len(key), 100_000):
            columns = [pa.array(key), *empty, pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c.slice(a, 100_000) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held, n_held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column(0)[i].as_py(), unpacked_words(batch.column(1)[i].as_py())
                ids = unpacked_ids(batch.column(2)[i].as_py(), len(words))
                status = np.append(word_status(known[0], lang, words), NONE)[ids]  # -1, a piece's end, takes the last
                for level in known[1:]:
                    status = pair_status(level, status)
                left, right = status[:-1], status[1:]
                both = (left >= 0) & (right >= 0)
                held += [left[both].astype(np.int32), right[both].astype(np.int32)]
                n_held += int(both.sum())
                if n_held >= HELD:
                    yield from flush(held)
                    held, n_held = [], 0
                if texts:
                    at = np.flatnonzero(~both & (left != NONE) & (right != NONE))
                    parts = [words.take(pa.array(ids[at + j])) for j in range(size)]
                    found = pc.binary_join_element_wise(*parts, " ").value_counts()
                    phrase, n = found.field(0), found.field(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(phrase), pa.int64()), pa.repeat(pa.scalar(lang), len(phrase)), phrase, n], names)
        yield from flush(held)

    schema = "key long, lang string, phrase string, n long" if texts else "key long, n long"
    return blocks.select("lang", "words", "ids").mapInArrow(run, schema)


def word_ids(levels: list[dict], key: np.ndarray) -> list[np.ndarray]:
    """The ids of the words of phrases that are pairs of the last level's ids."""
    pairs = []  # of each level but the words', by id
    for level in levels[1:]:
        pairs.append(np.zeros(int(level["ids"].max(initial=0)) + 1, np.int64))
        pairs[-1][level["ids"]] = level["keys"]

    def last(ids: np.ndarray, n: int) -> np.ndarray:
        for pair in reversed(pairs[:n]):
            ids = pair[ids] & 0xFFFFFFFF
        return ids

    out, rest = [], key
    for n in range(len(levels) - 1, -1, -1):  # the last word of the right part, then the same of the left part
        out.append(last(rest & 0xFFFFFFFF, n))
        left = rest >> 32
        rest = pairs[n - 1][left] if n else left
    return [rest, *reversed(out)]


def named(counted: DataFrame, levels: list[dict]) -> DataFrame:
    """lang, phrase, words, f, key of counted pairs of ids (key, f): their words are found
    by the dictionaries, without a join."""
    shared = counted.sparkSession.sparkContext.broadcast(levels)
    names = ["lang", "phrase", "words", "f", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        langs, held = zip(*known[0]["words"].items(), strict=True) if known[0]["words"] else ((), ())
        text = pa.chunked_array([words for words, _ in held], pa.string())
        start = np.array([ids[0] for _, ids in held], np.int64)
        base = np.cumsum([0, *[len(words) for words, _ in held]])[:-1]
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            ids = word_ids(known, key)
            of = np.searchsorted(start, ids[0], side="right") - 1  # a language's ids are in a row
            parts = [text.take(pa.array(i - start[of] + base[of])).combine_chunks() for i in ids]
            phrase = pc.binary_join_element_wise(*parts, " ")
            columns = [pa.array(langs, pa.string()).take(pa.array(of)), phrase, pa.repeat(pa.scalar(len(ids), pa.int32()), len(key)), batch.column(1), batch.column(0)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return counted.select("key", "f").mapInArrow(run, "lang string, phrase string, words int, f long, key long")


def most_frequent(phrases: DataFrame, limit: int) -> list:
    """The rows of `most_frequent_table`."""
    return most_frequent_table(phrases, limit).to_pylist()


def most_frequent_table(phrases: DataFrame, limit: int) -> pa.Table:
    """The rows of the highest counts, `limit` at most: whole count classes of
    a logarithmic histogram, so only its classes and the rows themselves move.  They stay
    Arrow columns: hundreds of thousands of Python rows are most of a small driver."""
    bucket = F.floor(F.log(F.col("f")) * 64)
    fits, at_least = 0, None
    for row in sorted(phrases.groupBy(bucket.alias("b")).count().collect(), reverse=True):
        fits += row["count"]
        if fits > limit:
            break
        at_least = row["b"]
    return (phrases.limit(0) if at_least is None else phrases.filter(bucket >= at_least)).toArrow()


def tile_ids(top: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """(the rows by language and frequency, the id of each): a language's from a new tile."""
    tie = "phrase" if "phrase" in top.column_names else "key"
    top = top.sort_by([("lang", "ascending"), ("f", "descending"), (tie, "ascending")])
    if not len(top):
        return top, np.zeros(0, np.int64)
    size = pc.value_counts(top["lang"].combine_chunks()).field("counts").to_numpy(zero_copy_only=False)  # in order of appearance
    tiles = np.concatenate([[0], np.cumsum(-(-size[:-1] // TILE))]) * TILE
    within = np.arange(len(top)) - np.repeat(np.cumsum(size) - size, size)
    return top, np.repeat(tiles, size) + within


def frequent_phrases(blocks: DataFrame, min_count: int = 100, longest: int = 5, max_ids: int = MAX_IDS) -> DataFrame:
    """lang, phrase, words, f of all phrases of 1 to `longest` words with
    f >= min_count."""
    single = (blocks.select("lang", "words", "counts").mapInArrow(_word_rows, "lang string, phrase string, n long")
              .groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count))
    found = [materialise(single.select("lang", "phrase", F.lit(1).alias("words"), "f", F.lit(None).cast("long").alias("key")), "phrases-1")]
    levels: list[dict] = []
    while len(found) < longest:
        n_frequent = found[-1].count()
        if n_frequent == 0:
            break
        if levels:  # numbers only
            rankable = found[-1].filter(F.col("key").isNotNull()).select("lang", "f", "key")
        else:
            rankable = found[-1].filter((F.octet_length("phrase") <= ID_BYTES) & (F.octet_length("lang") <= ID_BYTES)).select("lang", "f", "phrase")
        n_rankable = rankable.count()
        top, ids = tile_ids(most_frequent_table(rankable, max_ids))
        left_out = {"open": n_rankable > len(top), "texts": n_frequent > n_rankable}
        if levels:
            keys = top["key"].to_numpy()
            order = np.argsort(keys)
            levels.append({"keys": keys[order], "ids": ids[order].astype(np.int32)} | left_out)
        else:
            lang, phrase = top["lang"].combine_chunks(), top["phrase"].combine_chunks()
            at = {k.as_py(): np.flatnonzero(pc.equal(lang, k).to_numpy(zero_copy_only=False)) for k in pc.unique(lang)}
            levels.append({"words": {k: (phrase.take(pa.array(i)), ids[i]) for k, i in at.items()}} | left_out)
            del lang, phrase, at
        del top, ids
        texts = counted_by_text(levels[-1])
        counted = longer(blocks, levels).groupBy("key", *(["lang", "phrase"] if texts else [])).agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
        if texts:
            counted = materialise(counted, "phrase-counts")
        both = named(counted.filter(F.col("key").isNotNull()), levels)
        if texts:
            both = both.unionByName(counted.filter(F.col("key").isNull()).select("lang", "phrase", F.lit(len(levels) + 1).alias("words"), "f", "key"))
        found.append(materialise(both, f"phrases-{len(levels) + 1}"))
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out.drop("key")


def _salted(rows: DataFrame, other: DataFrame, on: list[str], often: DataFrame | None = None) -> DataFrame:
    """Left join of many rows per key with one row per key, dealt by a part of
    the phrase's hash: all keys, or those of `often` (the hash of a key) alone."""
    every, salt = F.sequence(F.lit(0), F.lit(SALT - 1)), F.pmod(F.xxhash64("phrase"), F.lit(SALT)).cast("int")
    if often is not None:
        marked = F.broadcast(often.withColumn("_often", F.lit(True)))
        rows, other = (x.withColumn("_key", F.xxhash64(*on)).join(marked, "_key", "left").drop("_key") for x in (rows, other))
        every, salt = F.when(F.col("_often"), every).otherwise(F.array(F.lit(0))), F.when(F.col("_often"), salt).otherwise(F.lit(0))
    dealt, rows = other.withColumn("salt", F.explode(every)), rows.withColumn("salt", salt)
    return rows.drop("_often").join(dealt.drop("_often"), [*on, "salt"], "left").drop("salt")


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 100, longest: int = 5,
                 top: int = 2000, max_ids: int = MAX_IDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases."""
    blocks = written_blocks(docs, lang_col, text_col)
    totals = blocks.select("lang", "counts").mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = frequent_phrases(blocks, min_count, longest, max_ids)
    phrases = counts.filter(F.col("words") > 1)

    inside = (phrases.select("lang", F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words") - 1))).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("within")))
    kept = phrases.join(inside, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (F.col("within") < F.col("f")))

    cuts = (kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words")).alias("rest")))
    side = lambda part, f: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    # a part with f occurrences begins at most f / min_count candidates of a length: few, unless it is frequent
    least = max(FREQUENT * min_count, (counts.agg(F.sum("f")).first()[0] or 0) / MAX_FREQUENT)
    often = materialise(counts.filter(F.col("f") >= least).select(F.xxhash64("lang", "phrase").alias("_key")).distinct(), "frequent-parts")
    parts = _salted(_salted(cuts, side("first", "l"), ["lang", "first"], often), side("rest", "r"), ["lang", "rest"], often)
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    scored = _salted(parts, totals, ["lang"]).withColumn("above", F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"]).withColumn("below", exact["l"] * exact["r"])
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").cast("long").alias("score"), "k", "l", "r")).alias("cut"))

    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = (lowest.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
            .filter(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top))
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                       "n", F.col("cut.score").alias("score"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS within
    FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i
          FROM (SELECT lang, w, a, m, unnest(range(2, m)) AS s FROM cand))
    GROUP BY ALL),
kept AS (
    SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase) WHERE i.within IS NULL OR 100 * i.within < 100 * c.a),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
    FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, fx.f AS l, fy.f AS r, t.n,
           CAST((1000::HUGEINT * c.a * t.n) // (fx.f::HUGEINT * fy.f) AS BIGINT) AS score
    FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = c.x JOIN f fy ON fy.lang = c.lang AND fy.phrase = c.y
    JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
WHERE rank <= 2000
"""
