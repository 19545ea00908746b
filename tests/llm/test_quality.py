import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from derlem.llm import quality as q


def force(docs):
    rows, refs = [], defaultdict(lambda: (Counter(), Counter()))
    for i, text, lang in docs:
        text, lang = text or "", lang or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        chars, words = Counter(), Counter()
        for c in text:
            chars[next((k for k, p in enumerate(q.CLASSES) if re.match(p, c)), 6)] += 1
        for x in w:
            words[x if x in q.COMMON_WORDS else ""] += 1
        refs[lang][0].update(chars)
        refs[lang][1].update(words)
        rows.append((i, lang, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), chars, words, len(text)))

    def distance(a, b):
        na, nb = sum(a.values()), sum(b.values())
        if not na or not nb:
            return 0
        total = 0
        for k in set(a) | set(b):
            x, y = a[k] / na, b[k] / nb
            total += (x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0)
        return math.sqrt(max(0, total / 2))

    out = []
    for i, lang, n, wc, sy, dl, rep, chars, words, size in rows:
        failed = n < 10 or 100 * rep > 20 * n
        far = size >= 200 and distance(chars, refs[lang][0]) > 0.28 or n >= 50 and distance(words, refs[lang][1]) > 0.45
        out.append((i, n, wc, sy, dl, rep, failed, not failed and not far))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_against_force(spark):
    r = random.Random(8)
    docs = []
    for i in range(150):
        w = [r.choice(["the", "of", "la", "Word", "xé", "a#b", "12"]) if r.random() < 0.5 else f"w{r.randrange(10**6)}" for _ in range(r.randrange(0, 200))]
        if i % 3 == 0:
            w += w[:30]
        if i % 10 == 0:
            w = [x + "###$$$" for x in w]
        docs.append((i, "".join(x + r.choice([" ", " ", "  ", "\n", "\t"]) for x in w), r.choice(["en", "fr", None])))
    docs += [(None, "a b", "en"), (900, None, None), (901, "", "de"), (902, "\n \n\t\nx\nx\n", "en"), (903, "word again " * 30000, "en"), (903, "word", "zz"), (904, "é" * 500, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("words", F.lit("clash")).withColumn("common", F.lit(1))
    got = q.judge(df).drop("char_distance", "word_distance").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r)) == force(docs)
    assert q.judge(df.limit(0)).count() == 0


def test_query_against_force(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, q.op7_quality_divergence(spark, sf).collect())) == force(docs)


def test_junk_goes_and_good_text_stays(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.op7_quality_divergence(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    share = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.7
