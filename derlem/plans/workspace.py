"""Where a session keeps tables of its own, such as search indexes."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession


def workspace(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, below it one for the application; a temporary one only where the session runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named}/{app}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own(app)


@lru_cache(maxsize=8)
def _own(app: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")
