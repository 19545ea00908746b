"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Separators of plain words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Rows and bytes (of the rows as JSON) up to which a lookup table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own if the session runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/derlem"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and later passes don't compute it again.

    The files outlive the loss of any executor; they go with the folder, or with ``release``."""
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that this driver has written, in order.
_written: list[str] = []


def written() -> int:
    """A mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete what was written since a mark, but for the last of it: for tables that nothing lazy reads any more."""
    for path in _written[since : len(_written) - keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _written[since : len(_written) - keep]


def lookup_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", rows: int | None = None, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join to a lookup table whose size is checked: broadcast up to limit rows and most_bytes, else a shuffled join that AQE splits at hot keys.

    right should be cheap to read (durable or small); rows: its row count, if known, of rows of a few numbers each."""
    if rows is None:
        size = right.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
        small = size["n"] <= limit and (size["b"] or 0) <= most_bytes
    else:
        small = rows <= limit
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def next_pow2_bits(n: float) -> int:
    """Least b with 2**b >= n."""
    return max(0, math.ceil(math.log2(max(1.0, n))))
