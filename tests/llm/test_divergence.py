import random
import re
from collections import Counter

from pyspark.sql import functions as F

from derlem.llm import divergence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def force(docs, least, ranks):
    """docs: (text, lang, source); every group against every term and every other group, zeros and all."""
    docs = [((t or "").translate(LOW), g or "", s or "") for t, g, s in docs]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in docs]
    out = []
    for lang in {g for _, g, _ in docs}:
        own = [(s, w) for (_, g, s), w in zip(docs, words) if g == lang]
        df = Counter(x for _, w in own for x in set(w))
        kept = sorted(x for x, n in df.items() if n >= least)
        counts = {}
        for s, w in own:
            counts.setdefault(s, Counter()).update(x for x in w if df[x] >= least)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            out += [(lang, s, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(pair)]
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(term[:ranks])]
    return sorted(out)


def run(spark, docs, least, ranks=10, **more):
    df = spark.createDataFrame([(i, t, g, s, "clash", 0) for i, (t, g, s) in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n int").repartition(3)
    found = divergence.audit(df, least, ranks, **more)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


def corpus(seed, n, sources=7):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma's", "d3lta", "éta", "ÉTA", "straße", "x", "日本", "the", "of", "and"]
    return [(" ".join(r.choice(words[: r.randint(2, 12)]) for _ in range(r.randint(0, 30))), r.choice(["en", "de"]), f"s{r.randrange(sources)}") for _ in range(n)]


def test_against_all_zeros(spark):
    docs = corpus(1, 150)
    assert run(spark, docs, 10) == force(docs, 10, 10)
    assert run(spark, docs, 1, 3) == force(docs, 1, 3)


def test_no_kept_terms_and_single_sources(spark):
    docs = [("a b c", "en", "x"), ("a", "en", "y"), ("", "en", "z"), ("a a", "fr", "alone")]
    got = run(spark, docs, 3)
    assert got == force(docs, 3, 10) and {r[4] for r in got} == {0} and {r[0] for r in got} == {"en"}


def test_odd_rows(spark):
    docs = [(None, None, None), (None, "en", None), ("Word word", None, "s"), ("word", "", ""), ("w " * 200_000, "en", "s"), ("é" * 100_000, "en", "s"), ("w", "en", "t"), ("w", "en", "t")]
    assert run(spark, docs, 1) == force(docs, 1, 10)
    assert run(spark, [], 1) == []


def test_hot_source_is_summed_in_tasks(spark):
    """Two thirds of all rows are of one source; a few texts are counted at a time."""
    docs = [(f"common w{i % 97} v{i % 13}", "en", "hot") for i in range(400)] + corpus(2, 200)
    assert run(spark, docs, 2, held=100) == force(docs, 2, 10)


def test_shares_beyond_a_long(spark):
    """Ten billion occurrences and more: the product with the unit doesn't fit into a long."""
    rows = [(12_345_678_901_234, 98_765_432_109_876, 1_234_567), (0, 10**15, 1)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]


def test_query_against_all_zeros(spark, sf):
    docs = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, divergence.op13_source_divergence(spark, sf).collect())) == force(docs, 10, 10)
