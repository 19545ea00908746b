import os

import pytest

from derlem.functions.vector import hashing_embedder
from derlem.operators import retrieval
from derlem.plans import library as lib
from derlem.plans.store import Store
from derlem.sources import files as sources
from derlem.sources import walk


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "in"
    for name in ("a.txt", "sub/b.TXT", "sub/deep/er/c.md", ".hidden/x.txt", "sub/node_modules/y.txt", "Mail.app/z.txt", "sub/~$b.docx", "sub/d.exe"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(f"kira {name}")
    (top / "empty.txt").write_text("")
    os.symlink(top, top / "sub" / "loop")
    os.symlink(top / "a.txt", top / "link.txt")
    return top


def names(rows, top):
    return sorted(os.path.relpath(r.path, top) for r in rows.collect())


def test_listing(spark, root, monkeypatch):
    got = sources.listing(spark, str(root))
    assert names(got, root) == ["a.txt", "sub/b.TXT", "sub/deep/er/c.md"]
    row = got.where("path like '%a.txt'").first()
    stat = os.stat(root / "a.txt")
    assert (row.mtime, row.size) == (stat.st_mtime_ns // 10**6, stat.st_size)
    two = sources.listing(spark, str(root / "sub" / "deep"), str(root / "Mail.app"))
    assert names(two, root) == ["Mail.app/z.txt", "sub/deep/er/c.md"]  # a root is entered whatever its name
    assert sources.listing(spark).count() == 0


def test_skipped_folders_are_not_opened(root, monkeypatch):
    opened, entries = [], walk.entries
    monkeypatch.setattr(walk, "entries", lambda folder: opened.append(os.path.relpath(folder, root)) or entries(folder))
    skipped = frozenset(sources.SKIPPED_DIRS)
    for folders in (1, 2, 1000):  # one task, some, one for each folder
        reader = walk.WalkReader([str(root)], skipped, folders)
        parts = reader.partitions()
        rows = [p for part in parts for b in reader.read(part) for p in b.column(0).to_pylist()]
        assert len(rows) == len(set(rows)) and sum(r.endswith((".txt", ".TXT", ".md")) for r in rows) == 4, folders
    assert set(opened) == {".", "sub", "sub/deep", "sub/deep/er"}
    assert list(walk.entries(str(root / "not there"))) == []


def test_contents_of_given_files_only(spark, root, tmp_path):
    here = sources.listing(spark, str(root)).where("path like '%.md'")
    gone = spark.createDataFrame([(str(root / "gone.txt"), 1, 1)], walk.SCHEMA)
    rows = {os.path.basename(r.path): r.content for r in walk.contents(here.union(gone)).collect()}
    assert {k: v and bytes(v) for k, v in rows.items()} == {"c.md": b"kira sub/deep/er/c.md", "gone.txt": None}
    failed = sources.documents(walk.contents(gone)).first()
    assert (failed.status, failed.body, failed.error_msg) == ("failed", "", "the file can't be read")


def test_scan_of_all_folders(spark, root, tmp_path):
    none = spark.createDataFrame([], lib.TABLES["metadata"])
    store = Store(spark, str(tmp_path / "s")).add_folder(str(root / "sub"), 1).add_folder(str(root / "Mail.app"), 2).add_folder("/not/there", 3)
    store = store.set(embeddings_enabled="true", chunk_size="12", chunk_overlap="3")
    step = lambda s: s.scan(embed=hashing_embedder(8), metadata=none)
    one, counts = step(store)
    assert counts == {"scanned": 3, "parsed": 3, "skipped": 0, "removed": 0}
    assert one.version == store.version + 1 and names(one.table("files"), root) == ["Mail.app/z.txt", "sub/b.TXT", "sub/deep/er/c.md"]
    assert one.table("chunks").count() > 3  # pieces of twelve characters
    (root / "sub" / "b.TXT").write_text("tahliye")
    os.remove(root / "Mail.app" / "z.txt")
    (root / "sub" / "e.md").write_text("yeni kira")
    same = root / "sub" / "deep" / "er" / "c.md"
    stat = os.stat(same)
    same.write_text("x" * stat.st_size)  # of the same size and time, so nobody opens it
    os.utime(same, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    two, counts = step(one)
    assert counts == {"scanned": 3, "parsed": 2, "skipped": 1, "removed": 1} and two.version == one.version + 1
    hits = retrieval.keyword(two.table("postings"), two.table("lengths"), "kira")
    files = two.table("files")
    assert names(files.join(hits, "id"), root) == ["sub/deep/er/c.md", "sub/e.md"]
    assert two.table("texts").count() == two.table("lengths").count() == 3
    assert step(two) == (two, {"scanned": 3, "parsed": 0, "skipped": 3, "removed": 0})


def test_chunk_settings(spark):
    of = lambda **kv: lib.chunk_settings(spark.createDataFrame(list(kv.items()), "key string, value string"))
    assert of() == (800, 150, False) and of(chunk_size="400", embeddings_enabled="true") == (400, 150, True)
    assert of(chunk_size="0", chunk_overlap="x", embeddings_enabled="yes") == (800, 150, False)
