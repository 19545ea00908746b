"""Nearest chunks without reading all vectors: each chunk belongs to the pivot that it is nearest to, and is stored with its angle to it.

Angles between vectors keep the triangle inequality: a chunk's angle to the query is at least the difference between the query's angle to a pivot
and its own. So a search scores the parts that may be nearest, and whatever lies within the reach of the kth score afterwards; of other parts, and
of the rest of a part, nothing has to be read, as rows are stored in order of part and angle. Results are those of ``retrieval.semantic``. How much
is left out depends on how clustered the vectors are; of vectors without any structure it is little."""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import LEAST_SIMILARITY, semantic, top

#: Vectors that are pivots, picked by hash; how far angles may be off for rounding; chunks for each result that the first parts hold.
PIVOTS, SLACK, LEAD = 256, 1e-5, 4
#: The part of chunks that no angle is known of: null, zero, not finite, of another length. They are always scored.
LOOSE = -1
SCHEMA = "file_id long, chunk_index int, text string, embedding array<float>, part int, angle double"


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _with_parts(chunks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """chunks with part and angle."""
    dims = pivots.shape[1] if len(pivots) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            part, angle = np.full(batch.num_rows, LOOSE, dtype=np.int32), np.zeros(batch.num_rows)
            whole = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims) if dims else np.zeros(0, dtype=np.int64)
            if len(whole):
                # A null component is NaN, and so has no angle.
                vectors = lists.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                angles = _angles(vectors, pivots)
                known = np.isfinite(angles).all(axis=1)
                near = np.argmin(np.where(known[:, None], angles, 0), axis=1)
                part[whole] = np.where(known, near, LOOSE)
                angle[whole] = np.where(known, angles[np.arange(len(near)), near], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(angle)], names=[*batch.schema.names, "part", "angle"])

    rows = chunks.select(F.col("file_id").cast("long"), F.col("chunk_index").cast("int"), "text", F.col("embedding").cast("array<float>"))
    return rows.mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Pivoted:
    rows: DataFrame
    pivots: np.ndarray
    parts: dict[int, tuple[float, float, int]]  # part -> (least angle, greatest angle, chunks); there are no more than pivots

    @classmethod
    def write(cls, chunks: DataFrame, path: str, pivots: int = PIVOTS) -> Pivoted:
        spark = chunks.sparkSession
        known = chunks.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
        length = known.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "n").first()
        picked = known.where(F.size("embedding") == length["n"]).orderBy(F.xxhash64("file_id", "chunk_index"), "file_id", "chunk_index").limit(pivots).select("embedding").collect() if length else []
        vectors = np.unique(np.array([r["embedding"] for r in picked], dtype=np.float64), axis=0) if picked else np.zeros((0, 0))
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if picked else vectors
        _with_parts(chunks, units).repartitionByRange("part", "angle").sortWithinPartitions("part", "angle").write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(json.dumps(units.tolist()),)], "pivots string").write.mode("overwrite").parquet(f"{path}/pivots")
        stored = spark.read.parquet(f"{path}/rows").groupBy("part").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
        stored.write.mode("overwrite").parquet(f"{path}/parts")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Pivoted:
        pivots = np.array(json.loads(spark.read.parquet(f"{path}/pivots").first()[0]), dtype=np.float64)
        return cls(spark.read.parquet(f"{path}/rows"), pivots, {r["part"]: (r["low"], r["high"], r["n"]) for r in spark.read.parquet(f"{path}/parts").collect()})

    def _within(self, reach: float, angle: dict[int, float]) -> Column:
        """Chunks whose angle to the query may be as small as reach."""
        near = [(p, a) for p, a in angle.items() if self._least(p, a) <= reach]
        # Bounds of a column that is stored in order: row groups outside of them are skipped.
        each = [(F.col("part") == p) & F.col("angle").between(a - reach - SLACK, a + reach + SLACK) for p, a in near]
        return reduce(operator.or_, each, F.col("part") == LOOSE)

    def _least(self, part: int, a: float) -> float:
        low, high, _ = self.parts[part]
        return max(0.0, a - high, low - a) - SLACK

    def search(self, vector: Sequence[float], k: int) -> tuple[DataFrame, DataFrame]:
        """(id, score, text of the best k files, as ``retrieval.top`` of ``retrieval.semantic`` has them; the chunks that were scored for them)."""
        column, q = F.array(*[F.lit(float(x)) for x in vector]), np.array([vector], dtype=np.float64)
        if not len(self.pivots) or q.shape[1] != self.pivots.shape[1] or not np.isfinite(q).all() or not q.any():
            return top(semantic(self.rows, column), k), self.rows
        angles = _angles(q, self.pivots)[0]
        angle = {p: float(angles[p]) for p in self.parts if p != LOOSE}
        lead, held = [], 0
        for p in sorted(angle, key=lambda p: (self._least(p, angle[p]), angle[p])):
            if held >= LEAD * k:
                break
            lead.append(p)
            held += self.parts[p][2]
        best = top(semantic(self.rows.where(F.col("part").isin(lead)), column), k).select("score").collect()  # k rows
        least = max(LEAST_SIMILARITY, min(r["score"] for r in best)) if len(best) == k else LEAST_SIMILARITY
        scored = self.rows.where(self._within(math.acos(min(1.0, least)) + SLACK, angle))
        return top(semantic(scored, column), k), scored
