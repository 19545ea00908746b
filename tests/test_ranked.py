import random

import pytest
from pyspark.sql import functions as F

from derlem.operators import retrieval
from derlem.operators.ranked import Ranked

SCHEMA = "id long, filename string, body string"
QUERIES = ("rare OR common", "rare common", "common -rare", "(rare OR mid) common", "com", "w1 OR w2 OR w3", "nothing", "nothing OR mid", "rare OR mid -common", "broken (")


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(3), []
    for i in range(3000):
        words = ["common"] * rng.randint(1, 4) + [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 30))]
        words += ["rare"] * rng.randint(1, 3) if i % 500 == 7 else []
        words += ["mid", "compound"] if i % 11 == 0 else []
        rng.shuffle(words)
        rows.append((i, f"{i}.txt", " ".join(words)))
    rows += [(5000, "empty.txt", ""), (5001, None, None), (5002, "", None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return Ranked.write(corpus, str(tmp_path_factory.mktemp("ranked")), block=16)


def rounded(rows):
    return [(r.id, round(r.score, 9)) for r in rows.collect()]


@pytest.mark.parametrize("query", QUERIES)
def test_the_same_best_as_scoring_all(spark, corpus, index, query):
    scored = retrieval.keyword(retrieval.postings(corpus), retrieval.doc_lengths(corpus), query)
    for k in (1, 10):
        assert rounded(index.search(query, k)[0]) == rounded(retrieval.top(scored, k)), query


def test_blocks_below_the_kth_score_are_not_scored(index):
    found, needed = index.search("rare OR common", 5)
    every = index.rows.where("term in ('rare', 'common')").count()
    read = index.rows.where("term in ('rare', 'common')").join(needed, "block", "left_semi").count()
    assert found.count() == 5 and read * 10 < every
    assert index.rows.where("term = 'rare'").count() == 6 and needed.count() <= 6


def test_bounds_hold(index):
    """No document scores more than the bound of its block."""
    from derlem.functions import query as q

    match = q.parse(q.normalise("common OR mid OR w1"), q.fold_words)
    cells = index._cells(match)
    idf = index._idf(match, cells)
    bounds = index._bounds(match, cells, idf)
    scores = index._scores(match, idf, bounds.select("block")).join(index.rows.select("id", "block").distinct(), "id")
    assert scores.join(bounds, "block").where(F.col("score") > F.col("bound") * (1 + 1e-9)).count() == 0 and scores.count() > 2900


def test_phrases_are_refused_and_empty_tables_searched(spark, index, tmp_path):
    with pytest.raises(ValueError, match="several words"):
        index.search('"rare common"', 3)
    none = Ranked.write(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert none.search("rare", 3)[0].collect() == []


def test_it_is_written_anew_for_other_files(spark, corpus, tmp_path):
    few = corpus.where("id < 20")
    Ranked.open(few, str(tmp_path))
    again = Ranked.open(few.withColumn("body", F.lit("changed")), str(tmp_path))
    assert again.search("changed", 30)[0].count() == 20 and again.search("common", 3)[0].count() == 0
