import pytest
from pyspark.sql import functions as F

from derlem.functions.vector import hash_vector, hashing_embedder
from derlem.plans.library import Library
from derlem.plans.search import SearchEngine

BODIES = {
    "a.txt": "İSTANBUL 3. AİLE MAHKEMESİ\nESAS NO: 2024/780\nDAVA DİLEKÇESİ\nkira tespit davasi ve tahliye",
    "b.txt": "tahliye ihtarname metni, kira yok",
    "c.txt": "ticari sözleşme ve tahliye talebi " * 40,
    "d.txt": "",
}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("library")
    root = top / "in"
    root.mkdir()
    for name, body in BODIES.items():
        (root / name).write_text(body or " ", encoding="utf-8")
    empty = Library.empty(spark)
    docs, _ = empty.scan(str(root))
    state = empty.ingest(docs).save(str(top / "one")).rebuild_chunks(hashing_embedder(32)).save(str(top / "two"))
    return state, root, top


def names(response):
    return [r.filename for r in response.results.collect()]


@pytest.fixture(scope="module")
def engine(library):
    state, _, _ = library
    return SearchEngine(state.files, state.metadata, state.chunks, lambda text: hash_vector(text.lower().split(), 32))


def test_keyword(engine):
    got = engine.search(" tahliye -ticari ")
    assert (got.mode, got.degraded, sorted(names(got))) == ("keyword", False, ["a.txt", "b.txt"])
    row = got.results.where("filename = 'a.txt'").first()
    assert "<b>tahliye</b>" in row.snippet and row.metadata.case_number == "2024/780" and row.path.endswith("/a.txt")
    assert names(engine.search("kira (a OR b)")) == [] and names(engine.search(None)) == []
    assert len(names(engine.search("tahliye", limit=1))) == 1 and len(names(engine.search("tahliye", limit=-1))) == 3


def test_infix(engine):
    got = engine.search('"HLİYE TAL"', mode="trigram", document_type="nothing has it")
    assert (got.mode, names(got)) == ("infix", ["c.txt"]) and "<b>hliye tal</b>" in got.results.first().snippet
    short = engine.search("'ab'", mode="infix")
    assert short.degraded and short.results.count() == 0


def test_semantic_and_hybrid(engine, library):
    got = engine.search("ihtarname metni, kira yok tahliye", mode="semantic")
    assert (got.mode, names(got)[0], got.results.first().snippet) == ("semantic", "b.txt", BODIES["b.txt"])
    both = engine.search("ihtarname", mode="hybrid")
    assert both.mode == "hybrid" and names(both)[0] == "b.txt"
    assert abs(both.results.first().score - 2 / 61) < 1e-12
    state, _, _ = library
    off = SearchEngine(state.files, state.metadata).search("ihtarname", mode="hybrid")
    assert (off.mode, off.degraded, names(off)) == ("keyword", True, ["b.txt"])

    def broken(text):
        raise OSError("no model")

    failed = SearchEngine(state.files, state.metadata, state.chunks, broken).search("ihtarname", mode="semantic")
    assert failed.degraded and "no model" in failed.reason and names(failed) == ["b.txt"]
    with pytest.raises(ValueError):
        engine.search("x", mode="psychic")


def test_facets(engine):
    assert names(engine.search("tahliye", document_type="dilekçesi")) == ["a.txt"]
    assert names(engine.search("tahliye", case_kind="esas")) == ["a.txt"]
    assert names(engine.search("tahliye", case_kind="SORUSTURMA")) == []


def test_steps(library, spark):
    state, root, top = library
    assert state.files.count() == 4 and state.metadata.count() == 3
    assert state.chunks.select("file_id").distinct().count() == 3
    patch = spark.createDataFrame([(f"{root}/a.txt", "yeni özet", None), ("/unknown", "x", "y")], "path string, summary string, court_name string")
    patched = state.patch_metadata(patch).metadata.where("summary is not null").collect()
    assert [(r.summary, r.court_name) for r in patched] == [("yeni özet", "İSTANBUL 3. AİLE MAHKEMESİ")]
    left = state.delete(spark.createDataFrame([(f"{root}/c.txt",)], "path string"))
    assert (left.files.count(), left.metadata.count(), left.chunks.count()) == (3, 2, 2)
    assert left.remove_folder(str(root)).files.count() == 0
    stats = state.stats(spark.createDataFrame([(str(root),)], "path string")).first().asDict()
    assert stats == {"folders": 1, "total_files": 4, "indexed_files": 4, "chunks": state.chunks.count()}
    bare = Library(state.files, state.metadata, state.chunks.where("false"))
    assert bare.backfill_chunks(hashing_embedder(32), limit=1).chunks.select("file_id").distinct().count() == 1
    (root / "b.txt").write_text("başka bir metin oldu")
    (root / "c.txt").unlink()
    docs, now = state.scan(str(root))
    after = state.ingest(docs).prune(str(root), now).save(str(top / "three"))
    assert {r.filename: r.body for r in after.files.where("filename in ('b.txt', 'c.txt')").collect()} == {"b.txt": "başka bir metin oldu"}
    b = after.files.where("filename = 'b.txt'").select(F.col("id").alias("file_id"))
    assert after.chunks.join(b, "file_id").count() == 0  # a chunk goes with the text it was made from
    assert after.chunks.count() == after.files.where("filename = 'a.txt'").count()
    given = state.ingest(docs, state.chunks.limit(0).unionByName(after.chunks.limit(1)))
    assert given.chunks.select("file_id", "chunk_index").distinct().count() == given.chunks.count()


def test_folders_and_settings(library, spark):
    state, _, _ = library
    one, above, pruned = state.add_folder("/a/b", 1)
    assert above is None and pruned.count() == 0
    two, above, _ = one.add_folder("/a/b/c/", 2)
    assert above == "/a/b" and two.folders.count() == 1
    same, above, _ = one.add_folder("/a/b", 3)
    assert above == "/a/b" and [tuple(r) for r in same.list_folders().collect()] == [("/a/b", 1)]
    wide, above, pruned = one.add_folder("/ab", 4)[0].add_folder("/a", 5)
    assert above is None and [r.path for r in pruned.collect()] == ["/a/b"] and [r.path for r in wide.list_folders().collect()] == ["/ab", "/a"]
    assert wide.remove_folder("/a", keep_files=True).folders.count() == 1 and wide.remove_folder("/a", keep_files=True).files.count() == 4
    kept = state.set(x="1", y="2").set(x=None, y="3")
    assert (kept.get("x"), kept.get("x", "none"), kept.get("y")) == (None, "none", "3")


def test_reading_enriching_and_models(library, spark):
    state, root, _ = library
    row = state.read(f"{root}/a.txt").first()
    assert row.case_number == "2024/780" and row.body.startswith("İSTANBUL") and state.read("/none").count() == 0
    assert state.read(f"{root}/d.txt").first().case_number is None
    rich = state.enrich(lambda body: F.when(F.contains(body, F.lit("kira")), '{"summary": "kira üzerine", "tags": [" kira ", ""]}'))
    got = {r.summary: r.tags for r in rich.metadata.collect()}
    assert got["kira üzerine"] == ["kira"]
    assert rich.metadata.where("summary is not null").count() == 2 and rich.metadata.where("case_number = '2024/780' and summary is not null").count() == 1
    assert state.use_model("minilm-l12", hashing_embedder)[1] is False and state.use_model("minilm-l12", hashing_embedder, force=True)[1] is True
    moved, rebuilt = state.use_model("nomic-embed-text", hashing_embedder)
    assert rebuilt and moved.get("indexed_model_dim") == "768" and len(moved.chunks.first().embedding) == 768
    assert moved.use_model("nomic-embed", hashing_embedder)[1] is False
    with pytest.raises(ValueError, match="bge-m3"):
        state.use_model("gpt", hashing_embedder)


def test_an_unknown_status_fails_the_writer(library, tmp_path):
    state, _, _ = library
    with pytest.raises(Exception, match="unknown status"):
        Library(state.files.withColumn("status", F.lit("odd")), state.metadata, state.chunks).save(str(tmp_path / "bad"))


def test_stored_index_is_repaired(library, tmp_path):
    from derlem.operators import retrieval

    state, _, _ = library
    retrieval.write_index(state.files.where("false"), str(tmp_path / "index"))
    for path in (tmp_path / "index", tmp_path / "missing"):
        engine = SearchEngine.stored(state.files, state.metadata, str(path))
        assert sorted(names(engine.search("kira tahliye"))) == ["a.txt", "b.txt"]
    plan = engine.index.where("term = 'kira'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,kira)" in plan


def test_fts_snippet_against_force(spark):
    import random
    import re

    from derlem.operators.retrieval import fts_snippet

    r = random.Random(5)
    words = [("kira", True), ("dava", False)]

    def force(body, width=6):
        parts = (body or "").split()
        hit = [any(w.startswith("kira") or w == "dava" for w in re.findall(r"[^\W_]+", p.lower())) for p in parts]
        best = max(((sum(hit[i : i + width]), -i) for i in range(len(parts)) if hit[i]), default=(0, 0))
        at = -best[1]
        shown = [f"<b>{p}</b>" if h else p for p, h in zip(parts[at : at + width], hit[at : at + width])]
        return ("..." if at else "") + " ".join(shown) + ("..." if len(parts) > at + width else "")

    bodies = [" ".join(r.choice(["kira", "Kiracı,", "dava", "davacı", "x", "(dava)", "y\n"]) for _ in range(r.randrange(40))) for _ in range(60)] + [None, "", "  ", "kira " * 3000]
    rows = fts_snippet(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), "body", words, width=6).collect()
    assert {x.id: x.snippet for x in rows} == {i: force(b) for i, b in enumerate(bodies)}


def test_stored_normalised_columns_give_the_same_substrings(library, tmp_path):
    from derlem.operators import retrieval

    state, _, _ = library
    retrieval.with_normalised(state.files).write.parquet(str(tmp_path / "files"))
    stored = state.files.sparkSession.read.parquet(str(tmp_path / "files"))
    for needle in ("İSTANBUL", "tahliye tal", "a.tx", "nowhere"):
        assert sorted(map(tuple, retrieval.infix(stored, needle).collect())) == sorted(map(tuple, retrieval.infix(state.files, needle).collect()))
