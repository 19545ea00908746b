"""What is made for an index is made once and in pieces; memory and time don't grow with the rows of a batch or with passes over the texts."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from derlem.functions import text as t
from derlem.functions import vector as v
from derlem.operators import ranked, retrieval, trigram
from derlem.plans import library as lib
from derlem.plans.store import Store


def table(spark, bodies):
    return spark.createDataFrame([(i, f"{i}.txt", b) for i, b in enumerate(bodies)], "id long, filename string, body string")


def counted(spark, files):
    """files whose texts count how often they are made."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(x):
        seen.add(1)
        return x

    return files.withColumn("body", body.asNondeterministic()("body")), seen


def test_texts_without_marks_are_told_quickly(spark):
    """Most characters are passed without meeting each run of the pattern."""
    rows = spark.range(1).select(F.repeat(F.lit("Größe ve ışık "), 400_000).alias("x")).localCheckpoint()
    without = t.uncomposed().replace(r"[\x{300}-\x{10ffff}&&", "", 1).removesuffix("]")
    took = []
    for pattern in (t.uncomposed(), without):
        began = time.time()
        assert rows.where(F.col("x").rlike(pattern)).count() == 0
        took.append(time.time() - began)
    assert took[0] * 2 < took[1]
    assert spark.range(1).where(F.lit("é").rlike(t.uncomposed())).count() == 1


def test_words_are_taken_from_texts_once_for_the_rows_of_an_index(spark, tmp_path):
    files, seen = counted(spark, table(spark, [f"kira w{i % 9}" for i in range(40)]))
    made = retrieval.staged(retrieval.posting_rows(files), str(tmp_path / "made"))
    retrieval.stored_postings(made).write.parquet(str(tmp_path / "postings"))
    assert seen.value == 40 and spark.read.parquet(str(tmp_path / "postings")).count() == 40 * 4
    files, seen = counted(spark, table(spark, [f"kira w{i % 9}" for i in range(40)]))
    ranked.Ranked.write(files, str(tmp_path / "ranked"))
    assert seen.value <= 80  # one for the fingerprint, one for the words
    assert not (tmp_path / "ranked" / "made").exists()


def test_trigrams_are_stored_as_lists(spark, tmp_path):
    bodies = [f"ortak metin {i} \U0001f600y" for i in range(300)] + ["", "ab", None]
    grams, texts = trigram.open_index(table(spark, bodies), str(tmp_path))
    want = {(b[k : k + 3], r.id) for r in texts.collect() for b in (r.body_tr, r.filename_tr) for k in range(len(b) - 2)}
    got = [(r.gram, r.id) for r in grams.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spark.read.parquet(str(tmp_path / "grams")).count() * 4 < len(got)


def test_lists_are_cut_at_a_piece(spark, monkeypatch):
    monkeypatch.setattr(trigram, "BATCH", 5)
    keys = trigram._keys("abcab")
    assert len(keys) == 3 and len(trigram._keys("ab")) == 0
    batch = trigram._listed(np.concatenate([keys, keys]), np.repeat([2, 1], 3))
    assert batch.to_pylist() == [{"gram": g, "ids": [1, 2]} for g in ("abc", "bca", "cab")]


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(retrieval, "PIECE", 10)
    lists = [["w"] * n for n in (3, 4, 25, 0, 9, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.string()))], names=["id", "words"])
    parts = list(retrieval.pieces(batch, 1))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5, 6]]
    assert list(retrieval.pieces(batch.slice(0, 0), 1)) == []


def test_vectors_of_pieces_are_those_of_lists(monkeypatch):
    monkeypatch.setattr(v, "PIECE", 20)
    lists = [[f"ş{i % 13}" for i in range(n)] for n in (0, 5, 41, 1, 30)] + [None]
    got = v.hash_vectors(pa.array([["x"], *lists], pa.list_(pa.string())).slice(1), 64).to_pylist()
    assert got == [v.hash_vector(x or [], 64).tolist() for x in lists]


def test_a_store_keeps_lists_of_trigrams_in_step(spark, tmp_path):
    rows = lambda ids, word: spark.createDataFrame([(i, f"/in/{i}.txt", f"{i}.txt", ".txt", 1, 9, f"{word} {i}", "indexed", None) for i in ids], lib.TABLES["files"])
    none = spark.createDataFrame([], lib.TABLES["metadata"])
    store = Store(spark, str(tmp_path / "s")).ingest(rows(range(30), "kira"), None, none).ingest(rows(range(0, 30, 3), "tahliye"), None, none)
    assert all(s["lists"] for s in store.state["grams"])
    for now in (store, store.merge(1)):
        want = {(b[k : k + 3], r.id) for r in now.table("texts").collect() for b in (r.body_tr, r.filename_tr) for k in range(len(b) - 2)}
        got = [(r.gram, r.id) for r in now.table("grams").collect()]
        assert len(got) == len(set(got)) and set(got) == want
