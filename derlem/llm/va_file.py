"""Exact top-k search by inner product with a vector-approximation file.

The file has one small cell for each dimension of each vector (``bits`` bits: equal parts of the dimension's range over all rows). For a
query, a vector's cells bound its score from both sides. Where all cells of a dimension are equally wide, both bounds are the product of the
query and the cells' lower corners, plus a number of the query's own, so scanning cells is a product of small matrices.

Queries go in rounds of at most ``per_round``, which is all that is broadcast. In a round

1. a scan of the cells gives each task's k best lower bounds of each query; the kth best of all is the query's floor,
2. a second scan keeps as candidates the vectors whose upper bound reaches the floor,
3. exact vectors are read in order of the upper bound, the best ones of every query first; a query ends as soon as its kth exact score beats
   the upper bounds of all that is left, else it goes on four times as deep. No candidate is ever left out that could still be a result.

The cells are a fraction of the vectors (a byte for a dimension as written), and exact vectors are only joined to candidates, by row
number: a vector that a third of all queries ask for is a skewed key of a plain join, which AQE splits.

Defined cases: vectors that are null or hold a null or non-finite component take no part; where lengths differ, missing components are
zeros, and an empty vector scores 0; rows that repeat a vec_id are rows of their own, as queries and as candidates, and only a query's own row
isn't its candidate; a null vec_id is no query, as a candidate it comes after others of the same score; an empty table, or one without
queries, gives an empty result; other columns are left out. Scores that may not fit into a long fail the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, release, table, written
from .vectors import exact_kind, matrix, quantised

K = 20
BITS = 6
#: Queries of a round: with 64 dimensions 25 MB as numbers of 8 bytes.
PER_ROUND = 50_000
#: Scores that a task holds at a time.
TILE = 1 << 22
RESULT = "query_id long, rank int, vec_id long, score long"


def _ranges(exact: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component of each dimension; zero counts where a vector is shorter. A row for each dimension and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = np.zeros(0, dtype=np.int64)
        for batch in batches:
            v = batch.column(0)
            if not len(v):
                continue
            dimensions = max(len(low), int(v.value_lengths().to_numpy(zero_copy_only=False).max()))
            m = matrix(v, dimensions)
            # A vector of fewer dimensions than others has zeros there, and so has what was seen before.
            grow = lambda a: np.pad(a, (0, dimensions - len(a)))
            low, high = np.minimum(grow(low), m.min(axis=0)), np.maximum(grow(high), m.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    rows = exact.select("v").mapInArrow(run, "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return np.array([min(0, r["low"]) for r in rows], dtype=np.int64), np.array([max(0, r["high"]) for r in rows], dtype=np.int64)


def _write_cells(exact: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """row, vec_id, cells: a byte for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = ((matrix(batch.column(2), len(low)) - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in cells], pa.binary())], names=["row", "vec_id", "cells"])

    return durable(exact.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, cells binary"), "cells")


def _least(kind: np.dtype) -> float:
    """Below every product."""
    return -np.inf if kind.kind == "f" else np.iinfo(kind).min // 2


def _products(batches: Iterator[pa.RecordBatch], queries: np.ndarray, own: np.ndarray, low: np.ndarray, width: np.ndarray) -> Iterator[tuple]:
    """(batch, first query, products of the tile's queries and the lower corners of the batch's cells); least possible at a query's own row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0).to_numpy()
        cells = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(rows), len(low))
        corners = (low + cells * width).astype(queries.dtype).T
        at = np.searchsorted(own, rows)
        mine = np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == rows))
        step = max(1, TILE // len(rows))
        for a in range(0, len(queries), step):
            products = queries[a : a + step] @ corners
            inside = mine[(at[mine] >= a) & (at[mine] < a + step)]
            products[at[inside] - a, inside] = _least(queries.dtype)
            yield batch, a, products


def _floors(cells: DataFrame, queries: np.ndarray, own: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> dict[int, int]:
    """Query number -> its kth largest product; none for a query with fewer than k candidates."""
    sent = cells.sparkSession.sparkContext.broadcast((queries, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = sent.value
        best = np.full((len(queries), k), _least(queries.dtype), dtype=queries.dtype)
        for _, a, products in _products(batches, queries, own, low, width):
            have = np.concatenate((best[a : a + len(products)], products), axis=1)
            best[a : a + len(products)] = np.partition(have, -k, axis=1)[:, -k:]
        for a in range(0, len(queries), 4096):
            q, j = np.nonzero(best[a : a + 4096] > _least(queries.dtype))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64) + a), pa.array(best[q + a, j].astype(np.int64))], names=["q", "s"])

    found = cells.mapInArrow(run, "q long, s long")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") == k)
    out = {r["q"]: r["s"] for r in ranked.select("q", "s").collect()}  # a row for each query of the round at most
    sent.destroy()
    return out


def _candidates(cells: DataFrame, queries: np.ndarray, own: np.ndarray, low: np.ndarray, width: np.ndarray, floors: dict[int, int]) -> DataFrame:
    """q, row, vec_id, upper: vectors whose upper bound reaches the query's floor."""
    over, under = (np.maximum(queries, 0) @ (width - 1).astype(queries.dtype)), (np.minimum(queries, 0) @ (width - 1).astype(queries.dtype))
    over, under = over.astype(np.int64), under.astype(np.int64)
    cut = np.array([floors[i] + int(under[i]) - int(over[i]) if i in floors else -(2**62) + 1 for i in range(len(queries))], dtype=np.int64)
    sent = cells.sparkSession.sparkContext.broadcast((queries, own, cut, over))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own, cut, over = sent.value
        for batch, a, products in _products(batches, queries, own, low, width):
            q, j = np.nonzero(products >= cut[a : a + len(products), None].astype(products.dtype))
            upper = products[q, j].astype(np.int64) + over[q + a]
            j = pa.array(j)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64) + a), batch.column(0).take(j), batch.column(1).take(j), pa.array(upper)], names=["q", "row", "vec_id", "upper"])

    out = durable(cells.mapInArrow(run, "q long, row long, vec_id long, upper long"), "candidates")
    sent.destroy()
    return out


def _scored(chosen: DataFrame, exact: DataFrame, queries: np.ndarray) -> DataFrame:
    """q, vec_id, score of chosen candidates: their exact vectors are read."""
    sent = chosen.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        for batch in batches:
            v = matrix(batch.column(2), queries.shape[1])
            score = np.einsum("ij,ij->i", v, queries[batch.column(0).to_numpy()].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["q", "vec_id", "score"])

    return chosen.join(exact.select("row", "v"), "row").select("q", "vec_id", "v").mapInArrow(run, "q long, vec_id long, score long")


def _read_in_order(candidates: DataFrame, exact: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """q, vec_id, score, rank: candidates' exact vectors by their upper bounds, until every query's kth score beats what is left."""
    order = Window.partitionBy("q").orderBy(F.desc("upper"), "row")
    left = durable(candidates.withColumn("place", F.row_number().over(order)), "ordered")
    best, depth, a = None, 4 * k, 0
    while True:
        now = left.where((F.col("place") > a) & (F.col("place") <= depth))
        found = _scored(now, exact, queries)
        found = found if best is None else best.drop("rank").unionByName(found)
        ranking = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        best = durable(found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k), "best")
        # What may still be a result: equal scores are decided by vec_id, so an upper bound that only equals the kth score is read too.
        kth = best.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
        left = durable(left.where(F.col("place") > depth).join(kth, "q", "left").where("kth is null or upper >= kth").drop("kth"), "left")
        if left.isEmpty():
            return best
        a, depth = depth, 4 * depth


def top_k(rows: DataFrame, query: Column, k: int = K, bits: int = BITS, per_round: int = PER_ROUND) -> DataFrame:
    """rows(vec_id, embedding) -> query_id, rank, vec_id, score: the k best of all other rows for each row that query holds for."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")
    spark = rows.sparkSession
    numbered = rows.select(F.col("vec_id").cast("long").alias("vec_id"), query.alias("asks"), quantised(F.col("embedding")).alias("v")).where("v is not null")
    exact = durable(numbered.withColumn("row", F.monotonically_increasing_id()), "vectors")
    low, high = _ranges(exact)
    asked = exact.where("asks").select("row", "vec_id", "v")
    n = asked.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    width = -(-(high - low + 1) // (1 << bits))
    # Corners reach below the range by less than a cell, so this bounds every product and both bounds.
    largest = int(np.maximum(-low, high + width).max(initial=0))
    kind = exact_kind(2 * max(1, len(low)) * largest * largest)
    cells = _write_cells(exact, low, width)
    rounds, out = -(-n // per_round), None
    for i in range(rounds):
        part = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == i)
        got = part.orderBy("row").collect()  # about per_round rows
        if not got:
            continue
        mark = written()
        own, ids = np.array([r["row"] for r in got], dtype=np.int64), [r["vec_id"] for r in got]
        queries = np.zeros((len(got), len(low)), dtype=kind)
        for j, r in enumerate(got):
            queries[j, : len(r["v"])] = r["v"]
        candidates = _candidates(cells, queries, own, low, width, _floors(cells, queries, own, low, width, k))
        best = _read_in_order(candidates, exact, queries, k)
        names = spark.createDataFrame(list(enumerate(ids)), "q long, query_id long")
        found = durable(best.join(F.broadcast(names), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
        release(spark, mark)  # the round's other tables
        out = found if out is None else out.unionByName(found)
    return out


def op11_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 20; candidates: all other rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
