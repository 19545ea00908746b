import random
import re
import time

import pytest
from pyspark.sql import functions as F

from derlem.functions import text as t


def chunks(text, size=800, overlap=150):
    """The windows one after the other."""
    x = re.sub(r"\s+", " ", text or "").strip(" ")
    if not text:
        return []
    if len(x) <= size:
        return [x]
    out, start = [], 0
    while True:
        window = x[start : start + size]
        at = window.rfind(" ")
        if start + size < len(x) and at > size - 100:
            window = window[:at]
        out.append(window)
        start += len(window) - overlap
        if len(window) <= overlap or start >= len(x):
            return out


@pytest.mark.parametrize(("size", "overlap"), [(800, 150), (300, 20), (5000, 700)])
def test_chunks_against_windows(spark, size, overlap):
    r = random.Random(size)
    texts = ["", " ", None, "a", "x" * 20_000, "😀 " * 9000, "ş" * 799 + " b" * 3000]
    texts += [" ".join("".join(r.choice("abçğ😀") for _ in range(r.choice([1, 5, 9, 150]))) for _ in range(n)) for n in (10, 300, 2000, 9000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", t.chunk_text(F.col("x"), size, overlap).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: chunks(x, size, overlap) for i, x in enumerate(texts)}


def test_matches_and_their_places(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab1ç😀2 ") for _ in range(n)) for n in (0, 1, 63, 64, 500, 9000)] + ["7" * 300, " 8" * 5000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", t.find_all(F.col("x"), "[0-9]+").alias("f")).collect()
    assert {r.i: [(m.at, m.value) for m in r.f or []] for r in rows} == {i: [(m.start(), m.group()) for m in re.finditer("[0-9]+", x or "")] for i, x in enumerate(texts)}
    sums = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 64, 65, 129, 4000)], "x array<bigint>").select("x", t.sums_before(F.col("x")).alias("s")).collect()
    assert all(row.s == [i * (i - 1) // 2 for i in row.x] for row in sums)


def test_long_texts_take_time_in_proportion(spark):
    df = spark.createDataFrame([("wort und text " * 143_000,)], "x string")
    began = time.time()
    assert df.select(F.size(t.chunk_text(F.col("x")))).first()[0] > 3000
    assert df.select(F.size(t.find_all(F.substring("x", 1, 200_000), "und"))).first()[0] > 14_000
    assert time.time() - began < 20  # two million characters took 53 s when each chunk counted from the text's start


def test_composed_text_is_that_of_the_standard(spark):
    import unicodedata

    rng = random.Random(5)
    pool = "aeiouIİıscgqz \u0307\u0301\u0323\u0308\u0327\u0345\u212b\u2126\u1f71\uf900\u1100\u1161\u11a8\uac00\u09c7\u09be\U0002f800\U0001d15e\U0001f600é"
    rows = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    rows += [chr(c) for c in range(0x20, 0x30000, 7) if not 0xD800 <= c < 0xE000] + [None, "", "e\u0301" * 300_000]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, x string").select("i", "x", t.composed(F.col("x")).alias("c")).collect()
    assert all(r.c == (None if r.x is None else unicodedata.normalize("NFC", r.x)) for r in got) and len(got) == len(rows)


def test_searches_find_letters_taken_apart(spark):
    from derlem.operators import retrieval

    files = spark.createDataFrame([(1, "a.txt", "I\u0307STANBUL"), (2, "b.txt", "istanbul"), (3, "c.txt", "ISTANBUL")], "id long, filename string, body string")
    for query in ("İstanbul", "I\u0307stanbul"):
        assert sorted(r.id for r in retrieval.infix(files, query).collect()) == [1, 2]
