"""Operator 8: n-gram Jaccard join by chosen-path recursion.

Texts become sets of k-word shingles (hashes; a text of fewer than k words is one
shingle).  Equal sets are one class (its documents are counted, not joined).
Every set is embedded as T minhash values, so that the sampled tokens are
(place, value) pairs that sets of similarity s share with probability s.

Chosen path: a run samples tokens at 1 / (threshold * T) each, so a set goes on to
1 / threshold children on average and two similar sets meet in one child or
more.  Buckets of at most SMALL sets are compared by brute force on their embeddings.
In larger ones the agreement of pairs is measured, over all pairs inside chunks of about
CHUNK sets.  Where half of the pairs or more are candidates already, further tokens
separate nothing: all sets of the bucket become candidates of each other, linked through
one of them, so that no pair of it is left out and the exact comparison decides.  Other
buckets are split again by as many tokens, sampled by the path, as leave a set with few
sets below the candidate bound (TOKENS at most), and by as many such paths as keep a pair
at the threshold together with probability `recall`; what is still large agrees on more
and is linked like a dense bucket.  A set so goes on to no more than paths_for(threshold,
TOKENS, recall) children of a bucket, however large that is.  Runs are
repeated until a pair at the threshold meets in a first bucket with probability `recall` or more.

Candidates (embedding agreement within five standard errors of the threshold)
form components.  Each component is then compared exactly, on whole shingle
sets, in blocks of bounded size (component x block pair): pairs stay inside the
task, which gives each set's number of links and a spanning forest of the
links.  No pair rows are emitted.

Result: one row per document: doc_id, class_id (smallest doc_id of the connected
class; its own if it has no link), n_links (other documents at the threshold or
above, copies included), n_text_links (linked sets other than its own).

Edge cases: null, empty and blank texts have no shingles: no links, class_id
their own id; texts of any length are used whole; documents with one text
link to each other; rows that repeat are counted as rows; a similarity equal to the threshold
counts; a null doc_id is a member like others and never names a class unless
the class has no other id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import Groups, gram_hashes, materialise, mix64, n_partitions, positional, restored, stream64, table, text_slices, word_bounds, word_hashes
from clausewise.llm.components import components

T = 64            # embedding size
SMALL = 1024      # sets compared by brute force in one bucket
CHUNK = 128       # sets among which the agreement of a larger bucket is measured
DEPTH = 1         # splits of a large bucket before all its sets become candidates
TOKENS = 6        # most tokens of one split
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, first of each row + total)."""
    starts, ends, first = word_bounds(data, off)
    h, at = gram_hashes(word_hashes(data, starts, ends), first, k)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(at)))


def set_keys(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128-bit key of each set, None for an empty one."""
    with np.errstate(over="ignore"):
        a, b = mix64(h), mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        n = len(at) - 1
        full = np.flatnonzero(np.diff(at) > 0)
        out = np.zeros((n, 2), np.uint64)
        if len(full):
            out[full, 0] = np.add.reduceat(a, at[full])
            out[full, 1] = np.add.reduceat(b, at[full])
    has = np.zeros(n, bool)
    has[full] = True
    return [out[i].tobytes() if has[i] else None for i in range(n)]


def embeddings(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """T minhash values (32 bits) of each set; empty sets get zeros."""
    n = len(at) - 1
    out = np.zeros((n, T), np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        mult, add = stream64(T, 31) | np.uint64(1), stream64(T, 32)
        with np.errstate(over="ignore"):
            for j in range(T):
                v = h * mult[j] + add[j]
                v ^= v >> np.uint64(32)
                v *= np.uint64(0x9E3779B97F4A7C15)
                out[full, j] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), at[full])
    return out


def runs_for(recall: float) -> int:
    """Runs until a pair at the threshold meets with probability `recall`: it
    meets in a run's first level unless none of the shared tokens is sampled (1 / e)."""
    return max(1, math.ceil(math.log(1 - recall) / -1.0))


def paths_for(threshold: float, m: int, recall: float) -> int:
    """Paths of m tokens until a pair at the threshold shares all tokens of one with
    probability `recall`."""
    shared = threshold ** m
    return 1 if shared >= recall else math.ceil(math.log(1 - recall) / math.log1p(-shared))


def root_tokens(threshold: float, runs: int) -> list[tuple[int, int]]:
    """(run, place): the tokens that each run samples at its root."""
    limit = np.uint64(int((1 << 64) / (threshold * T)) if threshold * T > 1 else (1 << 64) - 1)
    draw = stream64(T * runs, 41).reshape(runs, T)
    return [(r, int(i)) for r in range(runs) for i in np.flatnonzero(draw[r] < limit)] or [(0, 0)]


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, node (set key), n (its size), emb (T 32-bit values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column(1)):
                h, at = shingle_sets(data, off, k)
                emb = embeddings(h, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(set_keys(h, at), pa.binary()), pa.array(np.diff(at), pa.int64()),
                     pa.array([e.tobytes() for e in emb], pa.binary())], ["doc_id", "node", "n", "emb"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node binary, n long, emb binary")


def _paths(sets: DataFrame, tokens: list[tuple[int, int]]) -> DataFrame:
    """Root children: (key, node) for every sampled token of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_no, place = (np.array(x, np.uint64) for x in zip(*tokens, strict=True))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            emb = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, T)
            with np.errstate(over="ignore"):
                key = mix64(emb[:, place.astype(int)].astype(np.uint64) + ((run_no * np.uint64(T) + place + np.uint64(1)) << np.uint64(32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(n), len(tokens))))], ["key", "node"])

    return sets.select("node", "emb").mapInArrow(run, "key long, node binary")


def _agreement(rows: DataFrame, least: int) -> DataFrame:
    """(key, dense, steps) of the buckets of (key, load, node, emb), over all pairs inside
    chunks of about CHUNK sets.  dense: half of the pairs or more are candidates.
    steps: the fewest tokens (TOKENS at most) that leave a set with SMALL / 2 sets
    that are no candidates, where sets count by the number left with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in Groups("chunk")(batches):
            n = group.num_rows
            emb = np.frombuffer(b"".join(group["emb"].to_pylist()), np.uint32).reshape(n, T)
            same = np.array([(emb == e).sum(axis=1) for e in emb])
            near = same >= least
            share = np.where(near, 0, same) / T
            left = np.array([(share ** m).sum(axis=1) / max(n - 1, 1) for m in range(1, TOKENS + 1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([group["key"][0].as_py()] * TOKENS, pa.int64()), pa.array(range(1, TOKENS + 1), pa.int32()), pa.array([n * (n - 1)] * TOKENS, pa.int64()),
                 pa.array([int(near.sum()) - n] * TOKENS, pa.int64()), pa.array(left.sum(axis=1)), pa.array((left ** 2).sum(axis=1))],
                ["key", "m", "pairs", "near", "left", "left2"])

    chunk = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("load") / F.lit(CHUNK))))
    dealt = rows.select("key", chunk.alias("chunk"), "emb").repartition(n_partitions(rows), "chunk").sortWithinPartitions("chunk")
    found = dealt.mapInArrow(run, "key long, m int, pairs long, near long, left double, left2 double")
    found = found.groupBy("key", "m").agg(*[F.sum(c).alias(c) for c in ("pairs", "near", "left", "left2")])
    load = rows.groupBy("key").agg(F.max("load").alias("load"))
    fits = F.when(F.col("load") * F.col("left2") <= F.lit(SMALL / 2) * F.col("left"), F.col("m"))
    return found.join(load, "key").groupBy("key").agg(
        F.max(2 * F.col("near") >= F.col("pairs")).alias("dense"), F.coalesce(F.min(fits), F.lit(TOKENS)).alias("steps"))


def _split(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Children of (key, steps, node, emb): a path goes on by as many sampled
    tokens as its bucket's steps, and by so many such paths that a
    pair at the threshold keeps one with probability `recall`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy().view(np.uint64)
            steps = batch.column(1).to_numpy()
            emb = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, T)
            for m in np.unique(steps):
                at = np.flatnonzero(steps == m)
                for r in range(paths_for(threshold, int(m), recall)):
                    with np.errstate(over="ignore"):
                        child = mix64(key[at] + np.uint64(0x5851F42D4C957F2D) * np.uint64(r + 1))
                        for _ in range(m):
                            place = (mix64(child) % np.uint64(T)).astype(int)  # sampled by the path so far
                            child = mix64(child ^ (place.astype(np.uint64) << np.uint64(40))) + emb[at, place]
                            child = mix64(child)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(2).take(take), batch.column(3).take(take)], ["key", "node", "emb"])

    return rows.select("key", "steps", "node", "emb").mapInArrow(run, "key long, node binary, emb binary")


def forest(similar: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(similar))
    while True:
        grown = np.where(similar, label[None, :], len(label)).min(axis=1)
        grown = np.minimum(grown, label)
        grown = grown[grown]
        if (grown == label).all():
            return label
        label = grown


def _bucket_edges(rows: DataFrame, least: int) -> DataFrame:
    """(a, b): forest edges of the candidates inside each key's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list = []
        out_b: list = []
        for group in Groups("key")(batches):
            n = group.num_rows
            if n > 1:
                node = group["node"].to_pylist()
                emb = np.frombuffer(b"".join(group["emb"].to_pylist()), np.uint32).reshape(n, T)
                if n == 2:
                    if node[0] != node[1] and int((emb[0] == emb[1]).sum()) >= least:
                        out_a.append(node[0])
                        out_b.append(node[1])
                    continue
                same = np.empty((n, n), bool)
                for i in range(n):
                    same[i] = (emb == emb[i]).sum(axis=1) >= least
                root = forest(same)
                for i in np.flatnonzero(root != np.arange(n)):
                    if node[i] != node[root[i]]:
                        out_a.append(node[i])
                        out_b.append(node[root[i]])
            if len(out_a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    keyed = rows.select("key", "node", "emb").repartition(n_partitions(rows), "key").sortWithinPartitions("key")
    return keyed.mapInArrow(run, "a binary, b binary").distinct()


def _star(rows: DataFrame) -> DataFrame:
    """(a, b): all sets of a bucket as candidates of each other, through its first set."""
    first = rows.groupBy("key").agg(F.min("node").alias("a"))
    return rows.select("key", "node").join(first, "key").filter(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()


def candidate_edges(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Candidate pairs as forest edges per bucket (a, b) over (node, emb)."""
    tokens = root_tokens(threshold, runs_for(recall))
    least = max(1, math.floor(T * threshold - 5 * math.sqrt(T * threshold * (1 - threshold))))
    paths = _paths(nodes, tokens)
    # buckets with one set need no comparison: found on narrow rows before embeddings move
    load = paths.groupBy("key").agg(F.count("*").alias("load")).filter("load > 1")
    live = materialise(paths.join(load, "key"), "path-live")
    rows = live.join(nodes.select("node", "emb"), "node").select("key", "load", "node", "emb")
    found = None
    for level in range(DEPTH + 1):
        rows = materialise(rows, "path-rows")
        here = _bucket_edges(rows.filter(F.col("load") <= SMALL), least)
        found = here if found is None else found.unionByName(here)
        large = rows.filter(F.col("load") > SMALL)
        if large.isEmpty():
            break
        if level == DEPTH:
            # sets that agree on every sampled token
            found = found.unionByName(_star(large))
            break
        large = large.join(materialise(_agreement(large, least), "path-agreement"), "key")
        found = found.unionByName(_star(large.filter("dense")))
        kids = materialise(_split(large.filter("NOT dense"), threshold, recall), "path-kids")
        load = kids.groupBy("key").agg(F.count("*").alias("load")).filter("load > 1")
        rows = kids.join(load, "key").select("key", "load", "node", "emb")
    return found


def _exact(block: pa.Table, threshold: float) -> tuple:
    """Links of one block or block pair, on whole sets: (nodes, linked
    documents, linked sets, forest root or None)."""
    node, mult, part = block["node"].to_pylist(), block["copies"].to_numpy(), block["part"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in block["grams"].to_pylist()]
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    keep = shared[col]
    owner, col = owner[keep], (np.cumsum(shared) - 1)[col[keep]]
    common = np.zeros((n, n), np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):  # columns are sorted
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], col[a:b] - lo] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    link = common >= threshold * union - 1e-6
    np.fill_diagonal(link, False)
    full = link
    if (part != part[0]).any():
        link = link & (part[:, None] != part[None, :])
    return node, link @ mult, link.sum(axis=1), forest(full | np.eye(n, dtype=bool))


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8,
                       recall: float = 0.9995) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_text_links, is_first
    (the smallest id of its class; of several rows with that id, each)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialise(_sets(base, k), "jaccard-sets")
    nodes = sets.filter("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("emb").alias("emb"))
    nodes = materialise(nodes, "jaccard-nodes")
    comp = materialise(components(candidate_edges(nodes, threshold, recall)), "jaccard-candidates")
    members = comp.join(nodes.select("node", "copies", "rep", "n"), "node")
    # blocks of bounded sets and shingles
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("n_blocks"))
    members = members.join(blocks, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    members = materialise(members.select("node", "root", "rep", "copies", "n_blocks", "part"), "jaccard-members")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            for a, b, data, off in text_slices(batch.column(at_text)):
                h, at = shingle_sets(data, off, k)
                part = batch.slice(a, b - a)
                got = set_keys(h, at)
                ok = np.flatnonzero([g == w for g, w in zip(got, part.column(0).to_pylist(), strict=True)])
                take = pa.array(ok)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(take) for i in range(5)] + [pa.array([h[at[i]:at[i + 1]].tobytes() for i in ok], pa.binary())],
                    ["node", "root", "copies", "n_blocks", "part", "grams"])

    # a merge join at every size: texts are the large side, and the plan stays the same as tables grow
    text = members.alias("m").hint("merge").join(base.alias("b"), F.expr("m.rep <=> b.doc_id")).select("node", "root", "copies", "n_blocks", "part", "text")
    whole = text.mapInArrow(grams, "node binary, root binary, copies long, n_blocks int, part int, grams binary")
    # block pairs (i <= j) of a component: each set goes to the pairs of its block
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.struct(
        F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j"))))
    dealt = whole.withColumn("p", pair).withColumn("key", F.xxhash64("root", "p.i", "p.j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in Groups("key")(batches):
            # one row per set: repeated rows of the representative document give it twice
            seen: dict = {}
            for i, nd in enumerate(group["node"].to_pylist()):
                seen.setdefault(nd, i)
            group = group.take(pa.array(list(seen.values())))
            node, docs_linked, sets_linked, root = _exact(group, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.binary()), pa.array(docs_linked, pa.int64()), pa.array(sets_linked, pa.int64()), pa.array([node[r] for r in root], pa.binary())],
                ["node", "docs_linked", "sets_linked", "tree"])

    keyed = dealt.select("key", "node", "copies", "part", "grams").repartition(n_partitions(docs), "key").sortWithinPartitions("key")
    found = materialise(keyed.mapInArrow(compare, "node binary, docs_linked long, sets_linked long, tree binary"), "jaccard-links")
    links = found.groupBy("node").agg(F.sum("docs_linked").alias("docs_linked"), F.sum("sets_linked").alias("sets_linked"))
    real = components(found.select(F.col("node").alias("a"), F.col("tree").alias("b")))
    tagged = nodes.select("node", "copies", "rep").join(links, "node", "left").join(real, "node", "left")
    tagged = tagged.withColumn("root", F.coalesce("root", "node"))
    named = tagged.groupBy("root").agg(F.min("rep").alias("class_id"))
    tagged = materialise(tagged.join(named, "root").select(
        "node", "class_id", (F.coalesce("docs_linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("sets_linked", F.lit(0)).alias("n_text_links")), "jaccard-classes")
    out = sets.select("doc_id", "node").join(tagged, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One document of each class; columns stay.  Rows are told apart by a hash of
    id and text, so repeated or null ids do no harm; the row with the
    smallest hash stays (of equal rows, one)."""
    keyed, key, text = positional(docs, id_col, text_col)
    keyed = keyed.withColumn("_row", F.xxhash64(key, text))
    kept = similarity_classes(keyed, "_row", text, **params).filter("doc_id = class_id").select(F.col("doc_id").alias("_row")).distinct()
    kept = materialise(kept, "jaccard-kept")
    return restored(keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]), docs.columns)


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


# Words as the engine cuts them (ASCII white space); classes by a recursive walk.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(gram, chr(1) ORDER BY gram)) AS node FROM g GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE common >= 0.8 * (nx.size + ny.size - common) - 1e-6),
walk AS (
  SELECT doc_id AS node, doc_id AS reach FROM documents
  UNION SELECT walk.node, link.y FROM walk JOIN link ON link.x = walk.reach),
class AS (SELECT node AS doc_id, min(reach) AS class_id FROM walk GROUP BY node),
counted AS (
  SELECT x AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN sy.node <> sx.node THEN sy.node END) AS n_text_links
  FROM link JOIN sets sx ON sx.doc_id = x JOIN sets sy ON sy.doc_id = y GROUP BY x)
SELECT c.doc_id, c.class_id, coalesce(k.n_links, 0) AS n_links, coalesce(k.n_text_links, 0) AS n_text_links
FROM class c LEFT JOIN counted k ON k.doc_id = c.doc_id
"""
