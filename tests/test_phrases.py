import random

import pytest

from derlem.functions import sql
from derlem.functions.vector import cosine
from derlem.operators import retrieval


@pytest.mark.parametrize("rows", [20_000, 0])
def test_phrases_against_force(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(retrieval, "PHRASE_ROWS", rows)  # places broadcast, and places shuffled
    r = random.Random(5)
    texts = {i: [r.choice(["a", "b", "bc", "bd", "c"]) for _ in range(r.randrange(12))] for i in range(30)}
    files = spark.createDataFrame([(i, "a.txt", " ".join(w)) for i, w in texts.items()], "id long, filename string, body string")
    index = retrieval.posting_rows(files).cache()
    for words, prefix in ((("a", "b"), False), (("a", "a"), False), (("a", "b"), True), (("c", "a", "b"), True), (("a", "zz"), False), (("a", "txt"), False)):
        want = {}
        for i, body in texts.items():
            for said in (body, ["a", "txt"]):
                for k in range(len(said) - len(words) + 1):
                    part = said[k : k + len(words)]
                    if tuple(part[:-1]) == words[:-1] and (part[-1] == words[-1] or prefix and part[-1].startswith(words[-1])):
                        want[i] = want.get(i, 0) + 1
        got = retrieval._phrase(index, list(words), prefix).groupBy("id").sum("f")
        assert dict(map(tuple, got.collect())) == want, words
    index.unpersist()


def test_only_the_rarest_word_is_sent(spark):
    files = spark.createDataFrame([(i, "x", "of the " * 20 + ("court of the land" if i == 3 else "")) for i in range(50)], "id long, filename string, body string")
    index = retrieval.posting_rows(files).cache()
    found = retrieval._phrase(index, ["court", "of", "the"], False)
    assert [tuple(r) for r in found.collect()] == [(3, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "hashpartitioning" not in plan.replace("HashedRelationBroadcastMode", "")
    index.unpersist()


def test_functions_of_sql(spark):
    sql.register(spark)
    rows = [([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0], [1.0]), ([], [1.0]), (None, [1.0]), ([1.0, 2.0, 3.0], [3.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = spark.sql("SELECT cosine_similarity(a, b) AS x, a, b FROM {df}", df=df)
    assert all(abs(r.x - r.y) < 1e-12 for r in got.select("x", cosine(got.a, got.b).alias("y")).collect())
    assert tuple(spark.sql("SELECT tr_lower('IİSTANBUL'), search_tokens('Çok ÂLİ iş, 2x'), search_tokens(NULL)").first())[0] == "ıistanbul"
    assert spark.sql("SELECT search_tokens(NULL) AS t").first().t == []
