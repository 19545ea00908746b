"""What a store makes from texts is made once, by many tasks, and leaves few rows to sort."""

import random

from pyspark.sql import functions as F
from test_store import files, found, put, same_as_new

from derlem.functions import text as t
from derlem.operators import retrieval
from derlem.plans.store import Store


def rows(df):
    return sorted(map(repr, df.select("term", "id", "col", "positions").collect()))


def test_lists_have_the_same_postings(spark, monkeypatch):
    docs = files(spark, {9: "a b a c a", 2: None, 3: "", 4: "ÇA va, ça va!", 5: "x " * 5000, 6: "a", 7: "9 a txt"}).withColumn("digest", F.col("id") * 10)
    for words in (1, 9, 1_000_000):
        monkeypatch.setattr(retrieval, "LISTED", words)
        made = retrieval.posting_lists(docs).cache()
        lists = made.where("term is not null")
        assert rows(retrieval.list_rows(lists)) == rows(retrieval.list_rows(retrieval.packed(retrieval.list_rows(lists)))) == rows(retrieval.postings(docs))
        told = made.where("told is not null").select(F.inline("told"))
        assert {(r.id, r.length, r.digest) for r in told.collect()} == {(r.id, r.length, r.id * 10) for r in retrieval.doc_lengths(docs).collect()}
    assert all(r.ids == sorted(r.ids) for r in lists.select(F.col("rows.id").alias("ids")).collect())
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_store_sorts_lists_and_merges_them(spark, tmp_path):
    store = put(Store(spark, str(tmp_path / "s")), files(spark, {i: f"ortak metin w{i % 3}" for i in range(60)}).coalesce(1))
    segment = store.state["postings"][0]
    stored = spark.read.parquet(f"{store.path}/{segment['path']}/rows")
    assert segment["rows"] == store.table("postings").count() == 60 * 5 and stored.count() < 60 * 3
    assert sorted(p.name for p in (tmp_path / "s" / segment["path"]).parent.iterdir() if p.name in ("words", "ids")) == []
    for k in range(3):
        store = put(store, files(spark, {i: f"ortak yeni{k}" for i in range(k, 60, 7)}))
    store = store.delete(spark.createDataFrame([("/in/1.txt",)], "path string")).merge(most=1)
    assert found(store, "yeni2") == [i for i in range(2, 60, 7)] and 1 not in found(store, "ortak")
    same_as_new(spark, store, tmp_path / "fresh")


def test_texts_of_one_file_are_dealt_out(spark, tmp_path):
    """A table that comes in one piece is made into words, trigrams and normalised texts by several tasks."""
    draw = random.Random(1)
    docs = files(spark, {i: " ".join(f"{draw.getrandbits(60):x}" for _ in range(250)) for i in range(2000)}).coalesce(1)
    store = put(Store(spark, str(tmp_path)), docs)
    parts = lambda name: len(list((tmp_path / store.state[name][0]["path"] / "rows").glob("part-*.parquet")))
    assert parts("files") > 1 and parts("texts") > 1 and parts("postings") > 1


def test_blanks_collapse_as_before(spark):
    texts = ["", " ", "a", " a ", "a  b", "\ta\t\tb\n", "a \n b", " a  b  ", "a\r\n\r\nb ", " \n", "a b c", "\x1ca\x1c\x1d b", None]
    before = F.regexp_replace(F.regexp_replace("x", r"(?U)\s+", " "), r"^ | $", "")
    df = spark.createDataFrame([(x,) for x in texts], "x string").select(before.alias("a"), t.collapse_spaces(F.col("x")).alias("b"))
    assert all(r.a == r.b for r in df.collect())
