import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from derlem.llm import toxicity as t


def soup(r, n):
    return [r.choice(["an", "er", "th", "on", "re", "ou"]) * r.randrange(1, 3) + r.choice(["st", "ing", "ed", "ly", "nd"]) for _ in range(n)]


def corpus(n, seed=1):
    r, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words, bad = soup(r, r.randrange(5, 120)), i % 6 == 0
        for _ in range(r.randrange(1, 5) if bad else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(["Blockhead", "nitwit,", "dunderling"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_on_planted_words(spark):
    docs, labels = corpus(900)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("apart", F.lit(0))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.train(df, lab)
    got = {r.doc_id: r.score for r in t.scores(df, model).collect()}
    test = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((s >= t.THRESHOLD) == bool(y) for s, y in test)
    assert right / len(test) > 0.97
    kept = {r.doc_id for r in t.drop_toxic(df, model).collect()}
    assert kept == {i for i, s in got.items() if s < t.THRESHOLD}
    assert t.drop_toxic(df, model).schema == df.schema


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (t.train(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a == b


def test_labels_beyond_the_bound_keep_the_rate(spark):
    docs, labels = corpus(900)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    capped, whole = t.train(df, lab, t.TrainingBound(toxic=90, ordinary=90)), t.train(df, lab)
    assert capped.toxic and abs(capped.weights[0] - whole.weights[0]) < 0.7  # the sample's own rate would add 1.6
    rate = lambda bound: t.train(df.withColumn("text", F.lit("same")), lab, bound).weights[0]
    assert abs(rate(t.TrainingBound(toxic=90, ordinary=90)) - rate(t.TrainingBound())) < 0.05  # no model: the rate alone
    x, y = np.array([[1, 0, 0, 0], [1, 0, 0, 0], [1, 1, 1, 1], [1, 0, 0, 0]], dtype=float), np.array([0.0, 1, 1, 0])
    twice = [0, 0, 1, 2, 3, 3]
    assert np.allclose(t._fit(x, y, rows=np.array([2.0, 1, 1, 2])), t._fit(x[twice], y[twice]))


def test_copies_of_the_tables_beyond_the_bound_keep_the_predictions(spark):
    docs, labels = corpus(600)
    copies = lambda rows, n: [(i + 10_000 * k, x) for k in range(n) for i, x in rows]
    seen, df = [], spark.createDataFrame(docs, "doc_id long, text string")
    for n in (1, 4):
        many = spark.createDataFrame(copies(docs, n), "doc_id long, text string")
        model = t.train(many, spark.createDataFrame(copies(labels, n), "doc_id long, toxic int"), t.TrainingBound(toxic=200, ordinary=200))
        seen.append((model.weights[0], {r.doc_id: r.score >= t.THRESHOLD for r in t.scores(df, model).collect()}))
    (a, one), (b, four) = seen
    assert abs(a - b) < 0.5  # the sample's own rate would add 1.1
    assert sum(one[i] != four[i] for i in one) <= 3  # the dictionaries are learnt from another sample


def length(dictionary, size, shortest, data):
    p = zstandard.ZstdCompressionParameters.from_level(6, source_size=128, dict_size=size, min_match=shortest, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    dictionary.precompute_compress(compression_params=p)
    return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=p).compress(data))


def windows(text, n):
    words = (text or "").lower().split()
    return [(" " + " ".join(words[i : i + n]) + " ").encode() for i in range(0, len(words), n)]


def test_scores_are_differences_of_compressed_windows(spark):
    """Every score again, from the model's dictionaries and weights, with zstandard alone."""
    docs, labels = corpus(600)
    docs += [(9000, None), (9001, ""), (9002, "nitwit, dunderling"), (9003, "Blockhead " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = t.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    raw = lambda content: zstandard.ZstdCompressionDict(content + b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size, trained = len(model.ordinary + model.toxic) + 8, [zstandard.ZstdCompressionDict(d) for d in model.pair]
    for r in t.scores(df, model).collect():
        gains, apart = [], []
        for window in windows(dict(docs)[r.doc_id], 4):
            if not any(window[j : j + 6] in model.ordinary[-5:] + model.toxic + b" " * 8 for j in range(len(window) - 5)):
                continue  # shares no run with a stretch
            window += model.ordinary[-32:]
            gains.append(length(raw(model.ordinary), size, 6, window) - length(raw(model.ordinary + model.toxic), size, 6, window))
        for window in windows(dict(docs)[r.doc_id], 3):
            window += b" " * 32
            apart.append(length(trained[0], max(map(len, model.pair)), 4, window) - length(trained[1], max(map(len, model.pair)), 4, window))
        x = [1, max(0, max(gains, default=0) - t.GAIN) / 5, *[np.log1p(sum(g >= least for g in gains)) for least in (t.GAIN, t.LARGE)]]
        x += [max(0, max(apart, default=0) - t.APART + 1) / 5, *[np.log1p(sum(g >= least for g in apart)) for least in (t.APART, t.FAR)]]
        assert abs(r.score - 1 / (1 + np.exp(-np.dot(x, model.weights)))) < 1e-9 and r.gaining == sum(g >= t.GAIN for g in gains)


def test_training_again(spark):
    """Both dictionaries and the curve again, by loops over the training rows and zstandard's own trainer."""
    docs, labels = corpus(600)
    model = t.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    toxic, known = dict(labels), [(i, x) for i, x in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    learnt = {y: [x for i, x in known if toxic[i] == y and zlib.crc32(x.encode()) % 3] for y in (0, 1)}
    made = []
    for y, size, k in ((0, 112_640, 32), (1, 8_000, 10)):
        texts = sorted(set(learnt[y]), key=lambda x: (zlib.crc32(x.encode()), x))
        made.append(zstandard.train_dictionary(size, [w for x in texts for w in windows(x, 3)], k=k, d=6).as_bytes())
    assert model.pair == tuple(made)
    rest = [(x, y) for y in (0, 1) for i, x in known if toxic[i] == y and zlib.crc32(x.encode()) % 3 == 0]
    x, y = t._features(t._found(model, [x for x, _ in rest])), np.array([y for _, y in rest], dtype=float)
    want = 0.01 + 0.98 * y
    loss = lambda w: -(want * np.log(1 / (1 + np.exp(-x @ w))) + (1 - want) * np.log(1 / (1 + np.exp(x @ w)))).sum() + 0.00002 * len(y) / 2 * (w[1:] ** 2).sum()
    best = np.array(model.weights)
    assert (best[1:] >= 0).all()
    for i in range(len(best)):  # a least value among weights that aren't negative: no single weight can be changed for the better
        for step in (0.01, -0.01):
            other = best.copy()
            other[i] = other[i] + step if i == 0 else max(0, other[i] + step)
            assert loss(other) >= loss(best) - 1e-3


def test_phrases_of_ordinary_words_can_be_toxic_text():
    r = random.Random(2)
    ordinary = [" ".join(soup(r, 60)) for _ in range(300)]
    toxic = [" ".join([*soup(r, 30), "go to it now", *soup(r, 30)]) for _ in range(60)]
    assert any("go to it" in s.decode() for s in t.toxic_stretches(toxic, [*ordinary, *("go by it", "now to go") * 20]))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = t.op9_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()
    test = rows[rows.held_out].merge(labels, on="doc_id")
    assert np.mean(test.predicted == test.toxic) > 0.92  # a twentieth of the labels says toxic of texts without any sign of it


def test_odd_rows(spark):
    docs, labels = corpus(60)
    df = spark.createDataFrame([*docs, (None, "x"), (100, None), (101, ""), (102, "nitwit " * 40000), (102, "b")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0), (999, 1)], "doc_id long, toxic int")
    rows = t.scores(df, t.train(df, lab)).collect()
    assert len(rows) == 65 and len({r.score for r in rows if r.doc_id in (100, 101)}) == 1
    none = t.train(df, lab.limit(0))
    assert {r.score for r in t.scores(df, none).collect()} == {0.5}
    assert t.scores(df.limit(0), none).count() == 0


def test_texts_shorter_than_a_run():
    """One of a single word of two letters, with a blank at each end, is four bytes long."""
    for n in range(12):
        data = bytes(range(65, 65 + n))
        assert t._runs(data).tolist() == [int.from_bytes(data[i : i + t.RUN], "big") for i in range(n - t.RUN + 1)]
    short = ["", "a", "ab", "a b", "abc", "nit"]
    of = t.gains(b" to go and ", b" nitwit ")
    assert [of(x) for x in short] == [(0, 0, 0)] * len(short)
    assert t.toxic_stretches(["ab"] * 3, ["to go", "cd"]) == []
