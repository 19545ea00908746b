import hashlib
import math
import random

import pytest

from derlem.llm import lloyd


def force(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    end = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in end:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in end), key=repr)


def run(spark, rows, *args):
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, weight int, v string").repartition(3)
    return sorted(map(tuple, lloyd.clusters(df, *args).collect()), key=repr)


@pytest.mark.parametrize(("seed", "k", "rounds"), [(1, 5, 3), (2, 16, 2), (3, 3, 0)])
def test_against_loops(spark, seed, k, rounds):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [float(round(x + r.gauss(0, 0.2), 1)) for x in r.choice(centres)]) for i in range(200)]
    assert run(spark, rows, k, rounds, 6) == force(rows, k, rounds, 6)


def test_hot_vector_ties_and_empty_centroids(spark):
    """A third of all rows are one vector, most others repeat; equal first centroids leave the later ones empty."""
    rows = [(i, [0.5, -0.5]) for i in range(100)] + [(i, [float(i % 3), 0.0]) for i in range(100, 300)]
    assert run(spark, rows, 16, 3, 2) == force(rows, 16, 3, 2)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, float("-inf")]), (None, [2.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [-1.0, 0.0]), (8, [1.0, 2.0, 3.0])]
    assert run(spark, rows, 16, 3, 2) == force(rows, 16, 3, 2) and len(run(spark, rows, 16, 3, 2)) == 4
    assert run(spark, rows, 2, 3, 2) == force(rows, 2, 3, 2)
    assert run(spark, [], 16, 3, 2) == run(spark, rows, 16, 3, 9) == []


def test_large_components(spark):
    rows = [(i, [1e5 * (i % 4), -3e5 * (i % 5)]) for i in range(40)]
    assert run(spark, rows, 4, 2, 2) == force(rows, 4, 2, 2)
    with pytest.raises(Exception, match="large"):
        run(spark, [(1, [3e7] * 64), (2, [-3e7] * 64)], 4, 2, 64)


def test_query_against_loops(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, lloyd.op12_weighted_lloyd(spark, sf).collect()), key=repr) == force(rows, 16, 3, 64)
