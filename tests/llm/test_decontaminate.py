import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from derlem.llm import decontaminate as d


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def force(docs, items, width=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 900])
def test_against_force(spark, block):
    r = random.Random(4)
    say = lambda n: [r.choice(["the", "of", "É" + r.choice("ab"), "Word" + str(r.randrange(60))]) for _ in range(n)]
    items = [(i, " ".join(say(r.randrange(0, 40)))) for i in range(25)] + [(50, "lone"), (51, "Two Words!"), (52, None), (53, " -- "), (None, "of the"), (54, "a b c d e f g h i j k l m n"), (55, "a b c d e f g h i j k l m n")]
    docs = []
    for i in range(80):
        w = []
        for _ in range(r.randrange(0, 5)):
            part = r.choice(items)[1] or ""
            part = part.split()
            a = r.randrange(len(part) + 1)
            w += (part[a : a + r.randrange(1, 40)] if r.random() < 0.6 else say(r.randrange(20))) + [r.choice([",", "--", "x"])]
        docs.append((i, r.choice([" ", "  ", ". ", "\n"]).join(x.upper() if r.random() < 0.2 else x for x in w)))
    docs += [(90, None), (91, ""), (92, "a b c d e f g h i j k l m n " * 400), (None, "lone"), (93, "LONE-lone_lone")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("item", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(2))
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in d.contamination(df, bench, block_bytes=block).collect()}
    want = {i: (n, h, f) for i, n, h, f in force(docs, items)}
    assert want[None] == (1, 1, ["50"])  # a row without an id is judged like any other
    assert got == want
    kept = {r.doc_id for r in d.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}


def test_query_against_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(h and 20 * h >= n)) for i, n, h, f in force(docs, items))
    assert sorted(tuple(r) for r in d.op4_decontaminate(spark, sf).collect()) == want
    assert any(r[2] for r in want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert d.contamination(none, items).count() == 0
    assert d.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).first().n_hit == 0


def test_rows_of_one_id_are_judged_apart(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    bad = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(7, bad), (7, "tiny doc"), (7, bad), (None, bad), (None, "clean"), (8, bad + " x" * 20000), (9, None)], "doc_id long, text string").withColumn("_n_hit", F.lit("clash"))
    got = sorted(((r.doc_id or -1, r.n_words, r.n_hit) for r in d.contamination(docs, items).collect()))
    assert got == [(-1, 1, 0), (-1, 20, 20), (7, 2, 0), (7, 20, 20), (7, 20, 20), (8, 20020, 20), (9, 0, 0)]
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in kept.collect()) == [(-1, 5), (7, 8), (8, len(bad) + 40000), (9, 0)]


def test_sql_agrees_on_repeated_ids(spark, tmp_path):
    import duckdb

    from derlem.llm.sql import OP4

    item = " ".join(f"w{k}" for k in range(20))
    for name, rows, schema in (("documents", [(7, item), (7, "tiny doc"), (None, item), (8, "x"), (8, "x")], "doc_id long, text string"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = [tuple(r) for r in d.op4_decontaminate(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(OP4).fetchall(), key=str)


def test_a_vocabulary_beyond_the_broadcast_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"lead {i} " + " ".join(f"w{k}" for k in range(i, i + 15)) + " tail") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(8, 24))), (2, "lead 3")], "item_id long, text string")
    want = sorted(map(str, d.contamination(docs, items).collect()))
    monkeypatch.setattr(d, "VOCABULARY_ROWS", 3)
    assert sorted(map(str, d.contamination(docs, items).collect())) == want
