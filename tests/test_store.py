import os

import pytest
from pyspark.sql import functions as F

from derlem.functions.vector import hashing_embedder
from derlem.operators import retrieval
from derlem.plans import library as lib
from derlem.plans.store import Change, Conflict, Store


def files(spark, bodies, status="indexed"):
    rows = [(i, f"/in/{i}.txt", f"{i}.txt", ".txt", 1, len(b or ""), b, status, None) for i, b in bodies.items()]
    return spark.createDataFrame(rows, lib.TABLES["files"])


def put(store, docs, chunks=None):
    """Without the rules of legal texts, which take a while to plan."""
    return store.ingest(docs, chunks, store.spark.createDataFrame([], lib.TABLES["metadata"]))


def found(store, query):
    return sorted(r.id for r in retrieval.keyword(store.table("postings"), store.table("lengths"), query).collect())


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def same_as_new(spark, store, tmp_path):
    """Tables and index are those of a store that gets the same files at once."""
    fresh = put(Store(spark, str(tmp_path)), store.table("files"))
    for name in ("files", "postings", "lengths"):
        a, b = (sorted(map(repr, s.table(name).collect())) for s in (store, fresh))
        assert a == b, name


def test_search_sees_changes(spark, tmp_path):
    one = put(Store(spark, str(tmp_path / "s")), files(spark, {1: "kira davasi", 2: "tahliye talebi", 3: "kira ve tahliye", 4: None}))
    assert found(one, "kira") == [1, 3] and one.version == 1
    two = put(one, files(spark, {1: "ticari alacak", 5: "kira sözleşmesi"}))
    assert found(two, "kira") == [3, 5] and found(two, "ticari") == [1]
    three = two.delete(spark.createDataFrame([("/in/3.txt",), ("/unknown",)], "path string"))
    assert found(three, "kira") == [5] and found(three, "tahliye") == [2]
    four = three.prune("/in", spark.createDataFrame([("/in/1.txt",), ("/in/5.txt",), ("/in/4.txt",)], "path string"))
    assert found(four, "tahliye") == [] and four.table("files").count() == 3
    same_as_new(spark, four, tmp_path / "fresh")
    assert found(four.at(1), "kira") == [1, 3] and found(Store(spark, four.path), "kira") == [5]
    back = put(four, files(spark, {3: "kira geri"}))
    assert found(back, "kira") == [3, 5]
    same_as_new(spark, back, tmp_path / "fresh2")
    assert sorted(r.filename for r in back.engine().search("kira -yok").results.collect()) == ["3.txt", "5.txt"]
    assert found(back.remove_folder("/in"), "kira OR ticari") == []


def test_merged_segments_have_the_same_rows(spark, tmp_path):
    store = put(Store(spark, str(tmp_path / "s")), files(spark, {i: f"ortak metin w{i}" for i in range(40)}))
    for k in range(5):
        store = put(store, files(spark, {i: f"ortak yeni{k} w{i}" for i in range(k, 40, 7)})).delete(spark.createDataFrame([(f"/in/{k}.txt",)], "path string"))
    assert max(map(len, store.state.values())) <= 9
    same_as_new(spark, store, tmp_path / "fresh")
    small = store.merge(most=1)
    assert all(len(s) < len(store.state[n]) or len(s) == 1 for n, s in small.state.items())
    while any(len(s) > 1 for s in small.state.values()):
        small = small.merge(most=1)
    left = len(os.listdir(tmp_path / "s/segments"))
    assert small.vacuum() > 0 and len(os.listdir(tmp_path / "s/segments")) < left
    same_as_new(spark, Store(spark, small.path), tmp_path / "fresh4")


def test_a_change_writes_what_has_changed(spark, tmp_path):
    text = " ".join(f"word{i} metin{i % 50}" for i in range(400))
    store = put(Store(spark, str(tmp_path / "s")), files(spark, {i: f"{text} own{i}end" for i in range(300)}))
    before = folder_bytes(tmp_path / "s/segments")
    had = set(os.listdir(tmp_path / "s/segments"))
    after = put(store, files(spark, {7: f"{text} changed"}))
    new = set(os.listdir(tmp_path / "s/segments")) - had
    assert len(new) == 1 and folder_bytes(tmp_path / "s/segments" / new.pop()) < before / 10
    assert found(after, "changed") == [7] and found(after, "own7end") == []


def test_a_failure_between_tables_leaves_the_state_before(spark, tmp_path, monkeypatch):
    store = put(Store(spark, str(tmp_path)), files(spark, {1: "kira"}))
    write = Store._write

    def broken(self, name, change, folder):
        if name == "lengths":
            raise OSError("disk is full")
        return write(self, name, change, folder)

    monkeypatch.setattr(Store, "_write", broken)
    with pytest.raises(OSError, match="full"):
        put(store, files(spark, {1: "tahliye", 2: "tahliye"}))
    monkeypatch.undo()
    now = Store(spark, str(tmp_path))
    assert now.version == 1 and found(now, "kira") == [1] and found(now, "tahliye") == [] and now.table("files").count() == 1
    assert len(os.listdir(tmp_path / "segments")) == 2 and now.vacuum() == 1
    assert found(put(now, files(spark, {2: "tahliye"})), "kira OR tahliye") == [1, 2]


def test_of_two_writers_one_wins(spark, tmp_path):
    one = Store(spark, str(tmp_path)).set(a="1")
    other = Store(spark, str(tmp_path))
    one = one.set(a="2", b="3")
    with pytest.raises(Conflict):
        other.set(a="4")
    assert {r.key: r.value for r in Store(spark, str(tmp_path)).table("settings").collect()} == {"a": "2", "b": "3"}
    assert Store(spark, str(tmp_path)).set(a=None).table("settings").count() == 1
    with pytest.raises(ValueError, match="no state"):
        one.at(9)


def test_chunks_follow_their_documents(spark, tmp_path):
    docs = files(spark, {1: "eski metin", 2: "kalan metin", 3: "silinecek"})
    embed = hashing_embedder(8)
    store = put(Store(spark, str(tmp_path)), docs, lib.chunk_rows(docs, embed))
    texts = lambda s: {r.file_id: r.text for r in s.table("chunks").collect()}
    assert texts(store) == {1: "eski metin", 2: "kalan metin", 3: "silinecek"}
    store = put(store, files(spark, {1: "yeni metin", 2: "kalan metin", 3: ""}))
    assert texts(store) == {2: "kalan metin"}
    store = store.put_chunks(lib.chunk_rows(files(spark, {1: "yeni metin"}), embed))
    assert texts(store) == {1: "yeni metin", 2: "kalan metin"}
    assert texts(store.delete(spark.createDataFrame([("/in/2.txt",)], "path string"))) == {1: "yeni metin"}


def test_metadata_folders_and_reset(spark, tmp_path):
    store = Store(spark, str(tmp_path)).ingest(files(spark, {1: "ESAS NO: 2024/780", 2: "metin"})).add_folder("/in/deep", 1).add_folder("/in", 2).add_folder("/in/x", 3)
    assert [tuple(r) for r in store.table("folders").collect()] == [("/in", 2)]
    store = store.patch_metadata(spark.createDataFrame([("/in/1.txt", "özet"), ("/none", "x")], "path string, summary string"))
    store = store.ingest(files(spark, {1: "ESAS NO: 2024/781"}))
    assert [(r.case_number, r.summary) for r in store.table("metadata").where("file_id = 1").collect()] == [("2024/781", "özet")]
    assert store.library().stats().first().total_files == 2
    empty = store.reset()
    assert all(empty.table(n).count() == 0 for n in ("files", "metadata", "postings", "folders")) and empty.at(empty.version - 1).table("files").count() == 2
    with pytest.raises(Exception, match="unknown status"):
        empty.ingest(files(spark, {1: "x"}, status="odd"))
    assert Store(spark, str(tmp_path)).version == empty.version and empty.change(settings=Change(spark.createDataFrame([], lib.TABLES["settings"]))).version == empty.version


def test_rows_of_postings_are_the_same_without_a_shuffle(spark):
    docs = files(spark, {1: "a b a c a", 2: None, 3: "", 4: "ÇA va, ça va!", 5: "x " * 5000, 6: "a"})
    rows = retrieval.posting_rows(docs)
    key = lambda df: sorted(map(repr, df.select("term", "id", "col", "positions").collect()))
    assert key(rows) == key(retrieval.postings(docs)) and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_an_index_of_other_files_is_written_anew(spark, tmp_path):
    retrieval.open_index(files(spark, {1: "eski"}), str(tmp_path))
    for bodies, word in (({2: "eski"}, "eski"), ({2: "yeni başka"}, "yeni")):
        index, lengths = retrieval.open_index(files(spark, bodies), str(tmp_path))
        assert [r.id for r in retrieval.keyword(index, lengths, word).collect()] == [2] and lengths.count() == 1
    plain = spark.createDataFrame([(1, "a.txt", "bir"), (2, "b.txt", "iki")], "id long, filename string, body string")
    for body in ("bir", "üç"):
        index, _ = retrieval.open_index(plain.withColumn("body", F.when(F.col("id") == 1, body).otherwise(F.col("body"))), str(tmp_path / "plain"))
        assert index.where(F.col("term") == retrieval.q.fold_words(body)[0]).count() == 1
