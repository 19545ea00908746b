import hashlib
import random

import pytest
from pyspark.sql import functions as F

from derlem.llm import substring_dedup as s


def force(docs, width=13):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in docs]
    order = lambda i: s.NO_ID if i is None else i
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, s.NO_ID), order(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < order(i):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


key = lambda r: (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("bits", [7, -8])  # -8: nearly every window shares a counter, and the exact pass has to sort it out
def test_against_force(spark, bits):
    r = random.Random(5)
    passage = [[r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.randrange(10, 60))] for _ in range(6)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(r.randrange(0, 6)):
            words += r.choice(passage) if r.random() < 0.5 else [r.choice("xyz") + str(r.randrange(500)) for _ in range(r.randrange(30))]
        docs.append((i if i % 17 else None, r.choice(["  ", " ", "\n", "  "]).join(words)))
    docs += [(500, None), (501, ""), (502, " \t\n"), (7, docs[7][1]), (503, "w " * 3000), (504, "w " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash")).repartition(5)
    got = [tuple(x) for x in s.dedup_substrings(df, block_bytes=2000, range_windows=500, spare_bits=bits).collect()]
    assert sorted(got, key=key) == sorted(force(docs), key=key)


def test_query_against_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in force(docs))
    assert sorted(tuple(r) for r in s.op3_substring_dedup(spark, sf).collect()) == want
    assert any(r[2] for r in want)


def test_empty_table(spark):
    assert s.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_shuffled_once(spark, sf):
    df = s.op3_substring_dedup(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 2
