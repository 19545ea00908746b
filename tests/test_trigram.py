from pyspark.sql import functions as F

from derlem.operators import retrieval, trigram
from derlem.plans.search import SearchEngine

BODIES = ["İSTANBUL kira tespiti", "kira ve kira ve kira", "", None, "aaaaaa", "x\U0001f600yz ve kira", "ab", "(a+b) \\E % _ kira", "Isparta ışık"]
QUERIES = ["ra ve K", "istanbul", "aaa", "\U0001f600yz", "yok böyle", "ab", "b) \\e %", "4.txt"]


def table(spark, bodies=BODIES):
    return spark.createDataFrame([(i, f"{i}.txt", b) for i, b in enumerate(bodies)], "id long, filename string, body string")


def rows(df):
    return sorted((r.id, round(r.score, 9)) for r in df.collect())


def test_index_and_scan_agree(spark, tmp_path):
    files = table(spark)
    index = trigram.open_index(files, str(tmp_path))
    for query in QUERIES:
        assert rows(trigram.infix(*index, query)) == rows(retrieval.infix(files, query)), query
    assert [i for i, _ in rows(trigram.infix(*index, "kira"))] == [0, 1, 5, 7]
    again = table(spark, ["kira"])
    assert [i for i, _ in rows(trigram.infix(*trigram.open_index(again, str(tmp_path)), "kira"))] == [0]  # other files, another index
    empty = table(spark, [])
    assert rows(trigram.infix(*trigram.open_index(empty, str(tmp_path / "none")), "kira")) == []


def test_lists_of_every_length_agree(spark, tmp_path, monkeypatch):
    """Named ids, a broadcast list and a shuffled one leave the same documents."""
    files = table(spark, [f"ortak metin {i} w{i % 7}" for i in range(60)])
    index = trigram.open_index(files, str(tmp_path))
    want = rows(retrieval.infix(files, "n 1"))
    for named, sent in ((200, 20_000), (3, 20_000), (3, 0)):
        monkeypatch.setattr(trigram, "NAMED_IDS", named)
        monkeypatch.setattr(trigram, "BROADCAST_IDS", sent)
        assert rows(trigram.infix(*index, "n 1")) == want and want


def test_only_candidates_are_read(spark, tmp_path):
    """Texts in files of their own: those of other documents can be damaged, and the search doesn't notice."""
    files = table(spark, [f"metin {'kira ' * (i == 7)}{i}" for i in range(12)])
    grams, texts = trigram.open_index(files, str(tmp_path))
    parts = tmp_path / "parts"
    texts.repartitionByRange(12, "id").write.parquet(str(parts))
    texts = spark.read.parquet(str(parts))
    found = trigram.infix(grams, texts, "kira")
    scanned = texts.where(trigram._among([7])).select("id", "body_tr")
    read = scanned.withColumn("file", F.input_file_name()).collect()
    assert [r.id for r in read] == [7] and rows(found)[0][0] == 7
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(id,7)" in plan or "In(id, [7])" in plan
    ids, most = trigram.candidates(grams, "kira")
    assert (most, [r.id for r in ids.collect()]) == (1, [7])


def test_engine_uses_the_index(spark, tmp_path):
    files = table(spark).withColumn("path", F.concat(F.lit("/in/"), "filename"))
    metadata = spark.createDataFrame([(1, "Karar", "ESAS")], "file_id long, document_type string, case_kind string")
    engine = SearchEngine.stored(files, metadata, str(tmp_path))
    got = engine.search("ra ve", mode="infix").results.collect()
    assert [r.id for r in got] == [1] and "<b>ra ve</b>" in got[0].snippet and got[0].metadata.case_kind == "ESAS"
