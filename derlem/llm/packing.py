"""Best-fit packing of documents into training sequences, by bin completion.

Tasks encode whole texts where they are read and keep only the lengths (and, if asked, the ids). The number of pieces of each
length, at most one number per token of capacity, is all that the driver gets; it plans by branch and bound how often each filling is
used. Pieces of a length are numbered within the task that makes them, and the sums of the tasks before it are added later: no length is
gathered anywhere, however common. Each number's place is looked up in the plan, whose size the number of different lengths bounds.

Defined cases: null and empty texts are their end token alone; documents longer than the capacity are cut into full pieces, of which
the first may be shorter; null and repeated doc_ids are packed like any other row; an empty table gives an empty one; other columns
are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bin_completion import pack
from .common import durable, lookup_join, table
from .tokens import encoder

CAPACITY = 2048
END = 0


def piece_lengths(n: int, capacity: int) -> list[int]:
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + END.to_bytes(4, "little")
                start = 0
                for k, length in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(part), part), strict=True):
                        column.append(value)
                    start += length
            columns = [pa.array(c, t) for c, t in zip(rows[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p, dtype="<u4").astype(np.int32) for p in rows[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _places(packing: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For (length, number) in order, as one sortable key: the first key of each run, its first sequence, the offset there."""
    runs, sequence, used = [], 0, {}
    for filling, times in packing:
        offset = 0
        for length in filling:
            at = used.get(length, 0)
            runs.append(((length << 48) + at, sequence, offset))
            used[length] = at + times
            offset += length
        sequence += times
    runs.sort()
    key, first, offset = (np.array(x, dtype=np.int64) for x in (zip(*runs, strict=True) if runs else ([], [], [])))
    return key, first, offset


def numbered(parts: DataFrame) -> DataFrame:
    """parts with length -> the same with task and number: each row's number among those of its length in the same task, from 0.

    Which rows a task has is only fixed once the result is written."""
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, dtype=np.int64)
            count = np.diff(np.append(first, len(ordered)))
            number = np.empty(len(ordered), dtype=np.int64)
            number[order] = np.arange(len(ordered)) - np.repeat(first, count) + np.repeat([seen.get(n, 0) for n in ordered[first].tolist()], count)
            for n, k in zip(ordered[first].tolist(), count.tolist(), strict=True):
                seen[n] = seen.get(n, 0) + k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ordered), task)), pa.array(number)], names=[*names, "task", "number"])

    return parts.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", task long, number long")


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY, nodes: int = 6_000) -> DataFrame:
    """parts: rows with doc_id, piece and length, without columns task and number -> the same columns with sequence_id and offset."""
    kept = parts.columns
    parts = durable(numbered(parts), "pieces")
    sizes = durable(parts.groupBy("task", "length").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    key, first, offset = _places(pack(histogram, capacity, nodes), capacity)
    # A row for each task that has the length, at most: the one ordering that a length needs is over tasks.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = durable(sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "sums")
    rows = lookup_join(parts, sums, ["task", "length"]).select(*kept, (F.col("number") + F.col("before")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = (batch.column("length").to_numpy().astype(np.int64) << 48) + batch.column("number").to_numpy()
            run = np.searchsorted(key, want, side="right") - 1
            columns = [batch.column(c) for c in kept] + [pa.array(first[run] + want - key[run]), pa.array(offset[run])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n in kept) + ", sequence_id long, offset long"
    return rows.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str | None = None, nodes: int = 6_000) -> DataFrame:
    """docs(doc_id, text) -> pieces with the sequence and offset where they go."""
    return pack_pieces(pieces(docs, capacity, with_ids, vocabulary), capacity, nodes)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(*COLUMNS)
