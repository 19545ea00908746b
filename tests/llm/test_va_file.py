import math
import random

import pytest
from pyspark.sql import functions as F

from derlem.llm import va_file

SCHEMA = "vec_id long, embedding array<float>, row string, v int, cells int"


def force(rows, asks, k):
    """rows: (vec_id, vector) -> sorted (query_id, rank, vec_id, score)."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is None or not asks(q):
            continue
        found = [(-sum(s * t for s, t in zip(x, y)), i is None, i or 0) for b, (i, y) in enumerate(kept) if a != b]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, every, k, **more):
    df = spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    found = va_file.top_k(df, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)), k, **more)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def vectors(seed, n, dimensions=8, spread=1.0):
    r = random.Random(seed)
    return [(i, [float(round(r.gauss(0, spread), 2)) for _ in range(dimensions)]) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_any_cells_give_the_exact_result(spark, bits):
    rows = vectors(1, 150)
    assert run(spark, rows, 10, 7, bits=bits) == force(rows, lambda i: i % 10 == 0, 7)


def test_rounds_of_queries(spark):
    rows = vectors(2, 120)
    assert run(spark, rows, 3, 5, bits=4, per_round=15) == force(rows, lambda i: i % 3 == 0, 5)


def test_ties_and_repeated_vectors(spark):
    """Half of all rows are one vector: bounds part nothing, and equal scores go by vec_id."""
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(90)] + [(i, v[:3]) for i, v in vectors(3, 90)] + [(4, [1.0, 1.0, 1.0])] * 3
    assert run(spark, rows, 30, 20, bits=2) == force(rows, lambda i: i % 30 == 0, 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [float("nan"), 1.0]), (60, [1.0, None]), (80, [float("inf"), 0.0]), (None, [1.0, 2.0]), (None, [3.0, 3.0]), (5, []), (100, [-1.0, -1.0, 5.0]), (100, [2.0]), (7, [1.0, 2.0]), (3, [1.0, 2.0])]
    assert run(spark, rows, 20, 4) == force([(i, v if v is None or None in v else [*v, 0.0, 0.0, 0.0][:3]) for i, v in rows], lambda i: i % 20 == 0, 4)
    assert run(spark, rows[:1], 20, 4) == run(spark, [], 20, 4) == run(spark, [(1, [1.0])], 20, 4) == []
    assert run(spark, [(20, []), (40, [])], 20, 4) == [(20, 1, 40, 0), (40, 1, 20, 0)]


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 1e5 for x in v]) for i, v in vectors(4, 60)]
    exact = [(i, [float(F_(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, 10, 5, bits=4) == force(exact, lambda i: i % 10 == 0, 5)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(0, [1e12]), (1, [1.0])], 10, 5)


def F_(x):
    """x as the table's floats have it."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_query_against_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, va_file.op11_va_topk(spark, sf).collect()), key=repr) == force(rows, lambda i: i % 20 == 0, 20)
