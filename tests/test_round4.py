"""Findings of round 4: dictionaries of phrases, many small files, packed blocks."""

import numpy as np
import pyarrow as pa
import pytest

from clausewise.llm import collocations as C
from clausewise.operators import vectors
from clausewise.plans import catalog, intake
from clausewise.sources import ingest


def test_only_words_without_an_id_are_counted_by_text():
    """Frequent long words leave rare short ones out, and pairs of ranked words that are not frequent."""
    level = {"words": {"en": (pa.array(["b", "a"]), np.array([0, 1]))}, "open": False, "texts": True}
    words = pa.array(["a", "rare", "q" * 100, "b"])
    assert C.word_status(level, "en", words).tolist() == [1, C.NONE, C.OPEN, 0]
    assert C.word_status(level, "e" * 100, words).tolist() == [C.OPEN] * 4
    pairs = {"keys": np.array([1]), "ids": np.array([0], np.int32), "open": False, "texts": True}
    assert C.pair_status(pairs, np.array([0, 1, 0, C.OPEN, C.NONE])).tolist() == [0, C.NONE, C.OPEN, C.NONE]


def test_words_of_a_phrase_come_from_its_ids():
    words = {"words": {"en": (pa.array(["x", "y", "z"]), np.array([0, 1, 2]))}, "open": False, "texts": False}
    pairs = {"keys": np.array([1, 1 << 32 | 2, 2 << 32]), "ids": np.array([2, 0, 1], np.int32), "open": False, "texts": False}   # xy, yz, zx
    triples = {"keys": np.array([1, 2 << 32]), "ids": np.array([0, 5], np.int32), "open": False, "texts": False}                 # yzx, xyz
    got = C.word_ids([words, pairs, triples], np.array([5 << 32]))                                                              # xyz before yzx
    assert [i.tolist() for i in got] == [[0], [1], [2], [0]]


def test_a_dictionary_holds_what_fits_bytes_not_rows():
    """Pairs go to the tasks as numbers, so more than a few hundred thousand fit."""
    assert C.MAX_IDS * 12 <= 64_000_000 and C.MAX_IDS > 400_000


def test_small_files_are_listed_and_read_by_few_tasks(spark, tmp_path):
    n = ingest.READ_FILES + 100
    for i in range(n):
        folder = tmp_path / "in" / f"u{i}.txt"
        folder.mkdir(parents=True)
        (folder / "part").write_text(f"text {i}")
    before, asked = spark.conf.get(ingest.LISTING), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    back = ingest.read_uploads(spark, str(tmp_path / "in"), "folder")
    jobs = [asked.getJobInfo(j) for j in asked.getJobIdsForGroup("listing")]
    listed = max(asked.getStageInfo(s).numTasks for j in jobs for s in j.stageIds)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert listed <= ingest.LISTING_TASKS * 4 and spark.conf.get(ingest.LISTING) == before
    assert back.rdd.getNumPartitions() == 4   # the session's cores
    assert {(r.name, r.text) for r in back.collect()} == {(f"u{i}.txt", f"text {i}") for i in range(n)}


def test_uploads_have_no_checksum_files(spark, tmp_path):
    spark.range(3).selectExpr("id AS doc_id", "'t' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    folder, rows = catalog._uploads(spark, str(tmp_path), "documents", catalog._upload_name(), catalog.F.lit(True))
    catalog._write_uploads(rows, folder)
    import pathlib
    names = [p.name for p in pathlib.Path(folder.removeprefix("file:")).rglob("*") if p.is_file()]
    assert len([x for x in names if x.startswith("part-")]) == 3 and not [x for x in names if x.endswith(".crc") and "part-" in x]


def test_new_files_are_found_above_the_read(spark, tmp_path, monkeypatch):
    """An anti join would be moved below the coalesce, and the files read by tasks of a few each."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    plans, write = [], intake.written

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)
    monkeypatch.setattr(intake, "written", recorded)
    assert intake.audit_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", "r1").count() == 1
    (tmp_path / "in" / "b.txt").write_text("two")
    assert [r.name for r in intake.audit_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", "r2").collect()] == ["b.txt"]
    first, second = [p for name, p in plans if name == "intake-files"]
    assert "Join" not in first and "LeftAnti" not in second


@pytest.mark.parametrize("kind", ["dense", "bag"])
@pytest.mark.parametrize("side", [256, 3])
def test_packed_blocks_give_the_same_rows(spark, monkeypatch, kind, side):
    """Many pairs of blocks and groups: none is copied for each other, and the rows are those of few pairs."""
    monkeypatch.setattr(vectors, "MAX_SIDE", side)
    monkeypatch.setattr(vectors, "PACKED_FROM", 64)
    rng = np.random.default_rng(3)
    store = spark.createDataFrame([(f"s{i:03d}", [float(x) for x in rng.integers(0, 3, 8)], f"t{i}") for i in range(90)], "id string, embedding array<double>, text string")
    asked = rng.integers(0, 8, (80, 5)).tolist() if kind == "bag" else rng.integers(0, 3, (80, 8)).astype(float).tolist()
    queries = spark.createDataFrame(list(enumerate(asked)), f"query_id long, embedding array<{'int' if kind == 'bag' else 'double'}>")
    few = vectors.top_k_similar(queries, store, 3, query_kind=kind, payload_cols=["text"])
    many = vectors.top_k_similar(queries, store, 3, query_kind=kind, payload_cols=["text"], block_rows=10, query_rows_per_group=8)
    assert "CartesianProduct" in many._jdf.queryExecution().toString() and "CartesianProduct" not in few._jdf.queryExecution().toString()
    assert many.schema == few.schema
    rounded = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 9), round(r.distance, 9), r.text) for r in df.collect())
    assert rounded(many) == rounded(few)
