"""Live folders and change feeds, as Structured Streaming.

A file source reports each path once: changes of a file it has seen and deletions never show up in it, so a periodic rescan compares a
complete listing with the log. Both append to one log of parsed files; the state is the last row of each path. ``watch_into`` puts what arrives
into a stored library instead, whose ``scan`` does what a rescan does; ``fold_stream`` folds any feed of changes."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from ..operators.tables import changed, fold_changes, latest_wins, prune_missing
from ..plans.commits import CommitLog, Conflict
from ..plans.library import chunk_rows, chunk_settings
from ..plans.store import Store
from ..sources import files as sources


#: Segments of a folded table from which they are merged; how often a batch is tried against other writers of a store.
SEGMENTS, TRIES = 8, 5


def watch_files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """A stream of path, mtime, size and content of the files below root that are read; any path with a dot folder is ignored."""
    rows = (spark.readStream.format("binaryFile").schema(sources.BINARY).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", per_batch).load(root))
    rows = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    hidden = F.col("path").rlike("^" + re.escape(root.rstrip("/")) + r"/(.*/)?\.")
    return rows.where((F.col("size") > 0) & ~hidden & sources.wanted(F.col("path"), root))


def watch(spark: SparkSession, root: str, log: str, checkpoint: str, parsers: dict | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None, once: bool = False) -> StreamingQuery:
    """Parse what arrives below root and append it to the log, a Parquet table; a file that can't be read is a row too.

    enrich: parsed rows -> the same with more columns (metadata, chunks). A batch that is run again after a failure replaces its own rows."""

    def append(batch: DataFrame, number: int) -> None:
        rows = sources.parse(batch, parsers)
        rows = enrich(rows) if enrich else rows
        _seen_now(rows).write.mode("overwrite").parquet(f"{log}/batch=s{number}")

    query = watch_files(spark, root).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="2 seconds")).start()


def watch_into(spark: SparkSession, store: str, root: str, checkpoint: str, name: str, parsers: dict | None = None, embed: Callable[[Column], Column] | None = None, metadata: DataFrame | None = None, once: bool = False) -> StreamingQuery:
    """Put what arrives below root into the stored library below a path: files, metadata, both indexes and, if embed is given and the settings want
    them, chunks, in one commit for each batch.

    name: of this stream, kept through restarts. The store notes its last batch in the same commit, so a batch that is run again changes nothing; one
    that meets another writer's commit is repeated on the new state. Changes and removals of files that were seen: ``Store.scan``."""

    def into(batch: DataFrame, number: int) -> None:
        docs = sources.documents(batch, parsers)
        for left in reversed(range(TRIES)):
            now = Store(spark, store)
            size, overlap, wanted = chunk_settings(now.table("settings"))
            chunks = (lambda d: chunk_rows(d, embed, size, overlap)) if embed is not None and wanted else None  # noqa: B023
            try:
                now.ingest(docs, chunks, metadata, batch=(name, number))
                return
            except Conflict:
                if not left:
                    raise

    query = watch_files(spark, root).writeStream.queryName(name).foreachBatch(into).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="2 seconds")).start()


def _seen_now(rows: DataFrame, removed: bool = False) -> DataFrame:
    return rows.withColumn("removed", F.lit(removed)).withColumn("seen", F.lit(time.time_ns() // 1_000_000))


class Progress(StreamingQueryListener):
    """Reports (query name or id, batch, rows) after each batch with rows: spark.streams.addListener(Progress(print))."""

    def __init__(self, report: Callable[[str, int, int], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.report(event.progress.name or str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stop_all(spark: SparkSession) -> int:
    """Stop every running stream of the session; how many there were."""
    running = spark.streams.active
    for query in running:
        query.stop()
    return len(running)


def rescan(spark: SparkSession, root: str, log: str, parsers: dict | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append files that have changed since the log saw them, new ones that no stream has reported, and the removal of those that are gone."""
    known, now = current_files(spark, log), sources.listing(spark, root)
    rows = sources.read_documents(spark, root, parsers, changed(now, known)).drop("id")
    rows = enrich(rows) if enrich else rows
    gone = prune_missing(known, root, now)[1]
    _seen_now(rows).unionByName(_seen_now(gone, True), allowMissingColumns=True).write.parquet(f"{log}/batch=r{uuid.uuid4().hex}")


def current_files(spark: SparkSession, log: str) -> DataFrame:
    """The last row of each path in a log, without removed files."""
    rows = spark.read.parquet(log).drop("batch")
    return fold_changes(rows, "path", F.col("removed"), "seen", "mtime").drop("removed", "seen")


def fold_stream(feed: DataFrame, key: str, removed: str, version: list[str], state: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Fold a stream of changes into a table of each key's last one.

    The last change of a key is the stream's own keyed state (RocksDB), so a batch looks up and writes the keys that it has, however many there are.
    What it writes is a segment of the table below state, published as one commit, numbered like the batch: a batch that is run again finds its
    commit and does nothing. As soon as there are more than ``SEGMENTS``, the newest and those of their size are merged, in the same commit.
    removed: a boolean SQL expression. Rows that arrive late lose against a higher version, after a removal too."""
    spark = feed.sparkSession
    log = CommitLog(spark, state)
    row = F.struct(*[F.col(c) for c in feed.columns], F.expr(removed).alias("removed"))
    last = feed.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*version)).alias("_row")).select("_row.*")

    def segment(rows: DataFrame) -> dict:
        folder, seen = f"segments/{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{state}/{folder}")
        return {"path": folder, "rows": seen.get["n"]}

    def append(batch: DataFrame, number: int) -> None:
        known = log.versions()
        if number + 1 in known:
            return
        segments = log.read(known[-1])["segments"] if known else []
        made = segment(batch)
        segments = [*segments, made] if made["rows"] else segments
        if len(segments) > SEGMENTS:
            start, size = len(segments), 0
            while start and (len(segments) - start < 2 or segments[start - 1]["rows"] <= 2 * size):
                start -= 1
                size += segments[start]["rows"]
            rows = latest_wins(spark.read.parquet(*[f"{state}/{s['path']}" for s in segments[start:]]), key, *version)
            # Of what has been removed the stream's state knows: without older segments nothing is left to hide.
            segments = [*segments[:start], segment(rows if start else rows.where("not coalesce(removed, false)"))]
        log.commit(number + 1, {"segments": segments, "key": key, "version": version, "schema": batch.schema.json()})

    with _state_store(spark):
        query = last.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
        return (query.trigger(availableNow=True) if once else query).start()


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB; a stream that has started goes on with what it has."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def folded(spark: SparkSession, state: str, number: int | None = None) -> DataFrame:
    """Keys that a folded table still has after a batch, or after the last one."""
    log = CommitLog(spark, state)
    at = log.read(log.versions()[-1] if number is None else number + 1)
    schema = StructType.fromJson(json.loads(at["schema"]))
    rows = spark.read.schema(schema).parquet(*[f"{state}/{s['path']}" for s in at["segments"]]) if at["segments"] else spark.createDataFrame([], schema)
    return latest_wins(rows, at["key"], *at["version"]).where("not coalesce(removed, false)").drop("removed")
