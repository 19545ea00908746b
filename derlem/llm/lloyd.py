"""Centroid clustering by Lloyd's rounds over distinct quantised vectors.

Equal vectors go the same way, so they are grouped first (counted before they are shuffled, so a vector that a third of all rows have is a
row of each task) and a round is one pass over the distinct ones: tasks assign their vectors to the broadcast centroids and send a weighted
sum of integers for each centroid, which are summed by Spark; a row for each centroid and dimension comes to the driver. All arithmetic is
on integers and exact, so the result doesn't depend on how rows are dealt. In the end assignments are joined to the rows by their vector.

Defined cases: vectors that are null, hold a null or non-finite component, or haven't the asked number of components take no part; rows that
repeat a vec_id count as often as they are there, and if they are among the first, each starts a centroid; null vec_ids take part but start
centroids only where no others are left; with fewer vectors than centroids there are as many centroids as vectors; of equal centroids the
first gets the vectors; empty tables give an empty result; other columns are left out. Distances that may not fit into a long fail the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lookup_join, table
from .vectors import exact_kind, matrix, quantised

CENTROIDS, ROUNDS, DIMENSIONS = 16, 3, 64
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance) of each row; of equal distances the smaller number."""
    largest = int(max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = exact_kind(4 * max(1, v.shape[1]) * largest * largest)
    x, c = v.astype(kind), centroids.astype(kind)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(at)), at].astype(np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (rows, sum of each component over its rows); clusters without rows don't appear."""
    many, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = np.zeros(many, dtype=np.int64), np.zeros((many, dimensions), dtype=np.int64)
        for batch in batches:
            v, weight = matrix(batch.column(0), dimensions), batch.column(1).to_numpy()
            at, _ = _nearest(v, centroids)
            exact_kind(int(np.abs(v).max(initial=0)) * int(weight.sum()))
            for c in np.unique(at):
                own = at == c
                rows[c] += weight[own].sum()
                sums[c] += weight[own] @ v[own]
        c = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(rows[c]), pa.array(list(sums[c]), pa.list_(pa.int64()))], names=["cluster", "rows", "sums"])

    parts = distinct.select("v", "weight").mapInArrow(run, "cluster long, rows long, sums array<long>")
    each = parts.select("cluster", "rows", F.posexplode("sums").alias("d", "part")).groupBy("cluster", "d").agg(F.sum("rows").alias("rows"), F.sum("part").alias("sum"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.orderBy("cluster", "d").collect():  # a row for each centroid and dimension
        out.setdefault(r["cluster"], (r["rows"], []))[1].append(r["sum"])
    return out


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = _nearest(matrix(batch.column(0), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(distance)], names=["v", "weight", "cluster", "distance"])

    return distinct.select("v", "weight").mapInArrow(run, "v array<int>, weight long, cluster int, distance long")


def clusters(rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: str = "1") -> DataFrame:
    """rows(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each row that takes part.

    The first centroids are the vectors with the smallest hashes of seed and vec_id."""
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where(F.size("v") == dimensions)
    kept = durable(kept, "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(F.asc_nulls_last(drawn), "v").limit(centroids).collect()
    if not start:
        return spark.createDataFrame([], RESULT)
    now = np.array([r["v"] for r in start], dtype=np.int64)
    distinct = durable(kept.groupBy("v").agg(F.count("*").alias("weight")), "distinct")
    for _ in range(rounds):
        for c, (n, sums) in _sums(distinct, now).items():
            now[c] = [s // n for s in sums]
    assigned = durable(_assigned(distinct, now), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("distance")).alias("inertia")).collect()}
    total = sum(inertia.values())
    of = [(c, n, total, hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    named = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    found = lookup_join(kept, assigned.select("v", "cluster", "distance"), "v", "inner").join(F.broadcast(named), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))
