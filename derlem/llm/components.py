"""Connected components of a graph that is given as links, by alternating stars.

Each round links every node's larger neighbours to its least neighbour (large star), then every node and its smaller
neighbours to the least of them (small star), until all nodes of a component hang on its least node. Sums go before
shuffles, a hub's links are only ever joined to one row, and each round's links are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    to = _least(both).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(to, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    to = _least(down)
    moved = down.join(to, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(to.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, root), root the least node of the component; nodes without a link to another don't appear."""
    mark = written()
    edges = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = durable(_small(durable(_large(edges), "large")), "small")
        release(edges.sparkSession, mark)  # of the rounds only the last one is read again
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
