import io
import zipfile

from pyspark.sql import functions as F

from derlem.operators import tables
from derlem.plans.commits import CommitLog
from derlem.plans.library import TABLES
from derlem.plans.store import Store
from derlem.sources import files as s
from derlem.streaming import feed


def archive(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, text)
    return out.getvalue()


def fill(root):
    (root / "sub").mkdir()
    (root / ".hidden").mkdir()
    (root / "node_modules").mkdir()
    (root / "a.udf").write_bytes(archive("content.xml", "<x><![CDATA[ESAS NO :  2024/1\r\n\r\n\r\nson]]></x>"))
    (root / "b.docx").write_bytes(archive("word/document.xml", "<w:p><w:t>Bir &amp; iki</w:t></w:p><w:p><w:t>üç</w:t></w:p>"))
    (root / "sub" / "c.TXT").write_text("düz  metin", encoding="utf-8")
    (root / "sub" / "d.pdf").write_bytes(b"%PDF")
    (root / "bad.udf").write_bytes(b"nothing here")
    (root / "empty.txt").write_bytes(b"")
    (root / "~$a.docx").write_bytes(b"x")
    for d in (".hidden", "node_modules"):
        (root / d / "n.txt").write_text("n")


WANT = {
    "a.udf": ("indexed", "ESAS NO : 2024/1\nson"), "b.docx": ("indexed", "Bir & iki\nüç"), "c.TXT": ("indexed", "düz metin"), "d.pdf": ("failed", ""), "bad.udf": ("failed", ""),
}


def test_folder_becomes_documents(spark, tmp_path):
    fill(tmp_path)
    rows = s.read_documents(spark, str(tmp_path)).collect()
    assert {r.filename: (r.status, r.body) for r in rows} == WANT
    assert all((r.error_msg is None) == (r.status == "indexed") for r in rows)
    assert {r.path.rsplit("/", 1)[-1] for r in s.listing(spark, str(tmp_path)).collect()} == set(WANT)
    read = s.read_documents(spark, str(tmp_path), parsers={".pdf": lambda b: b.decode()}).where("ext = '.pdf'").first()
    assert (read.status, read.body) == ("indexed", "%PDF")


def test_changed_and_missing_files(spark, tmp_path):
    fill(tmp_path)
    before = spark.createDataFrame(s.listing(spark, str(tmp_path)).collect(), "path string, mtime long, size long")
    (tmp_path / "sub" / "c.TXT").write_text("much longer now")
    (tmp_path / "a.udf").unlink()
    now = s.listing(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in tables.changed(now, before).collect()] == ["c.TXT"]
    kept, gone = tables.prune_missing(before, str(tmp_path), now)
    assert [r.path.rsplit("/", 1)[-1] for r in gone.collect()] == ["a.udf"] and kept.count() == len(WANT) - 1


def test_watch_appends_versions(spark, tmp_path):
    root, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    root.mkdir()
    fill(root)
    feed.watch(spark, str(root), log, check, once=True).awaitTermination()
    (root / "sub" / "c.TXT").write_text("second version")
    (root / "new.md").write_text("added")
    feed.watch(spark, str(root), log, check, once=True).awaitTermination()
    state = lambda: {r.filename: (r.status, r.body) for r in feed.current_files(spark, log).collect()}
    assert state() == WANT | {"new.md": ("indexed", "added")}
    (root / "a.udf").unlink()
    feed.rescan(spark, str(root), log)
    want = WANT | {"c.TXT": ("indexed", "second version"), "new.md": ("indexed", "added")}
    assert state() == {k: v for k, v in want.items() if k != "a.udf"}


def fold(spark, folder, schema, tmp_path):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = feed.fold_stream(stream, "user_id", "event_type = 'error'", ["ts", "event_id"], str(tmp_path / "state"), str(tmp_path / "check"))
    query.awaitTermination()
    return query


def test_fold_stream_agrees_with_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    query = fold(spark, str(tmp_path / "events"), events.schema, tmp_path)
    got = feed.folded(spark, str(tmp_path / "state"), query.lastProgress["batchId"])
    want = tables.fold_changes(events, "user_id", F.col("event_type") == "error", "ts", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fold_stream_goes_on_and_writes_what_a_batch_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "SEGMENTS", 3)
    source, schema = str(tmp_path / "in"), "user_id long, event_type string, ts long, event_id long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    now = lambda: {r.user_id: (r.event_type, r.ts) for r in feed.folded(spark, str(tmp_path / "state")).collect()}
    put([(u, "view", 1, u) for u in range(2000)])
    fold(spark, source, schema, tmp_path)
    put([(5, "click", 3, 1), (6, "error", 3, 2), (7, "view", 0, 3), (None, "view", 1, 4)])
    fold(spark, source, schema, tmp_path)
    assert now()[5] == ("click", 3) and 6 not in now() and now()[7] == ("view", 1) and now()[None] == ("view", 1) and len(now()) == 2000
    log = CommitLog(spark, str(tmp_path / "state"))
    assert [s["rows"] for s in log.read(log.versions()[-1])["segments"]] == [2000, 4]  # the second batch wrote its own keys only
    for k in range(3):
        put([(6, "view", 2, 5 + k)])  # late: the removal is newer
        fold(spark, source, schema, tmp_path)
    last = log.read(log.versions()[-1])["segments"]
    assert len(last) <= feed.SEGMENTS and 6 not in now() and len(now()) == 2000
    fold(spark, source, schema, tmp_path)
    assert len(now()) == 2000 and len(feed.folded(spark, str(tmp_path / "state"), 0).collect()) == 2000


def test_watch_into_a_store(spark, tmp_path):
    root, path = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    (root / "a.txt").write_text("kira davası")
    (root / "b.md").write_text("tahliye")
    none = spark.createDataFrame([], TABLES["metadata"])
    run = lambda: feed.watch_into(spark, path, str(root), str(tmp_path / "check"), "inbox", metadata=none, once=True).awaitTermination()
    found = lambda word: sorted(r.filename for r in Store(spark, path).engine().search(word).results.collect())
    run()
    assert found("kira") == ["a.txt"] and found("tahliye") == ["b.md"]
    (root / "c.txt").write_text("kira ve tahliye")
    run()
    store = Store(spark, path)
    assert found("kira") == ["a.txt", "c.txt"] and store.batches == {"inbox": 1}
    again = store.ingest(store.table("files").withColumn("body", F.lit("x")), metadata=none, batch=("inbox", 1))
    assert again is store  # a batch that is run again
    (root / "a.txt").unlink()
    (root / "b.md").write_text("yeni metin")
    store, counts = store.scan(str(root), metadata=none)
    assert counts["removed"] == 1 and counts["parsed"] == 1 and found("kira") == ["c.txt"] and store.batches == {"inbox": 1}


def test_watch_into_meets_another_writer(spark, tmp_path, monkeypatch):
    root, path = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    (root / "a.txt").write_text("kira")
    none, publish, met = spark.createDataFrame([], TABLES["metadata"]), Store._publish, []

    def late(self, segments, batch=None):
        if batch and not met:
            met.append(Store(spark, path).set(model="m"))  # somebody else commits first
        return publish(self, segments, batch)

    monkeypatch.setattr(Store, "_publish", late)
    feed.watch_into(spark, path, str(root), str(tmp_path / "check"), "inbox", metadata=none, once=True).awaitTermination()
    store = Store(spark, path)
    assert store.table("settings").collect()[0]["value"] == "m" and store.table("files").count() == 1 and store.version == 2
