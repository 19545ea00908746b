"""A library on disk: its five tables and the search index, changed together.

Each table is a row of segments, oldest first. A change writes a segment for each table that it touches: the new rows, and the keys that
they replace or remove (tombstones). A row counts if no later segment names its key. So a change writes what has changed, whatever the
library's size, and the index is never behind its documents: both are published by one commit (see commits). Reading joins rows to the
keys of later segments, which are few until segments are merged: ``merge`` rewrites the newest segments into one as soon as there are many,
and older ones with them when together they have grown as large, so each row is rewritten a number of times that grows with the
logarithm of the library.

Segments aren't changed once they are written, so every earlier state can be read until ``vacuum`` removes it. A change that fails halfway
leaves files that no state names; ``vacuum`` removes them too."""

from __future__ import annotations

import operator
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval, tables, trigram
from ..sources import files as sources
from ..sources import walk
from . import library as lib
from .commits import CommitLog, Conflict
from .search import SearchEngine

__all__ = ["Conflict", "Store"]

#: Table -> (schema, key).
STORED = {
    **{name: (schema, {"files": "path", "folders": "path", "settings": "key"}.get(name, "file_id")) for name, schema in lib.TABLES.items()},
    "postings": ("term string, id long, col int, positions array<int>", "id"),
    "lengths": ("id long, length long, digest long", "id"),
    "grams": ("gram string, id long", "id"),
    "texts": ("id long, filename_tr string, body_tr string, length long", "id"),
}
#: Tables of the indexes; how rows are laid out where that matters.
INDEX = ("postings", "lengths", "grams", "texts")
LAYOUT = {
    "files": lambda rows: rows.repartition("path"),  # what is made from texts is made by as many tasks as there are, whatever they come in
    "postings": retrieval.stored_lists,
    "grams": trigram.stored_grams,
    "texts": trigram.stored_order,
}
#: Tables whose rows stand in lists -> how lists are stored, made of rows and read as rows.
LISTED = {"postings": (retrieval.LISTS, retrieval.packed, retrieval.list_rows, "rows"), "grams": (trigram.LISTS, trigram.packed, trigram.gram_rows, "ids")}
#: Keys of later segments up to which they are broadcast.
BROADCAST_KEYS = 1_000_000
#: Segments of a table from which it is merged.
SEGMENTS = 8


@dataclass(frozen=True)
class Change:
    """rows: new ones. keys: of the rows that go; the keys of new rows are always among them, and needn't be looked for if they are covered.
    made: the rows cost more to make than to write, so they are made once and put in order after it. placed: they are in order."""

    rows: DataFrame | None = None
    keys: DataFrame | None = None
    covered: bool = False
    made: bool = False
    placed: bool = False


class Store:
    """The library below a path, as one of its states has it; a change returns the store in the next state."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self._log = spark, path.rstrip("/"), CommitLog(spark, path)
        known = self._log.versions()
        self.version = (known[-1] if known else 0) if version is None else version
        if self.version and self.version not in known:
            raise ValueError(f"no state {version} in {path}")
        read = self._log.read(self.version) if self.version else {}
        self.state: dict[str, list[dict]] = read.get("tables", {})
        self.batches: dict[str, int] = read.get("batches", {})  # stream -> its last batch

    def at(self, version: int) -> Store:
        return Store(self.spark, self.path, version)

    # Reading

    def table(self, name: str) -> DataFrame:
        return self._live(name, self.state.get(name, []))

    def _read(self, folder: str, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{what}")

    def _rows(self, name: str, segment: dict) -> DataFrame:
        """A segment's rows; those of the indexes stand in lists."""
        if segment.get("lists"):
            schema, _, unpacked, _ = LISTED[name]
            return unpacked(self._read(segment["path"], "rows", schema))
        return self._read(segment["path"], "rows", STORED[name][0])

    def _live(self, name: str, segments: list[dict]) -> DataFrame:
        schema, key = STORED[name]
        having = [(i, s) for i, s in enumerate(segments) if s["rows"]]
        if not having:
            return self.spark.createDataFrame([], schema)
        # One scan of all segments of an age: a name for each folder costs the plan nothing but its place in the order.
        rows = [self._rows(name, s).withColumn("_segment", F.lit(i)) for i, s in having]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        last = self._keys(name, [(i, s) for i, s in enumerate(segments) if i > having[0][0]])
        if last is not None:
            few = sum(s["keys"] for s in segments[1:]) <= BROADCAST_KEYS
            last = last.groupBy(key).agg(F.max("_segment").alias("_last"))
            out = out.join(F.broadcast(last) if few else last, key, "left").where("_last is null or _segment >= _last")
        columns = [c.split()[0] for c in schema.split(", ")]
        return out.select(*columns)

    def _keys(self, name: str, segments: list[tuple[int, dict]]) -> DataFrame | None:
        schema, key = STORED[name]
        of = next(c for c in schema.split(", ") if c.split()[0] == key)
        out = None
        for i, s in segments:
            if s["keys"]:
                more = self._read(s["path"], "keys", of).withColumn("_segment", F.lit(i))
                out = more if out is None else out.unionByName(more)
        return out

    def library(self) -> lib.Library:
        return lib.Library(**{name: self.table(name) for name in lib.TABLES})

    def engine(self, embedder=None) -> SearchEngine:
        return SearchEngine(self.table("files"), self.table("metadata"), self.table("chunks"), embedder, self.table("postings"), self.table("lengths").select("id", "length"), self.table("grams"), self.table("texts"))

    # Writing

    def _write(self, name: str, change: Change, folder: str) -> dict:
        """A segment of one table."""
        schema, key = STORED[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        n, out = {"rows": 0, "keys": 0}, f"{folder}/{name}"
        if change.rows is not None:
            number = F.count(F.lit(1))
            if name in LISTED:
                _, packed, _, lists = LISTED[name]
                rows, n["lists"], number = change.rows if lists in change.rows.columns else packed(change.rows), True, F.sum(F.size(lists))
            else:
                rows = change.rows.select(*[F.col(c).cast(t).alias(c) for c, t in (c.split(" ", 1) for c in schema.split(", "))]).select(*columns)
            if name == "files":
                rows = tables.checked_status(rows)
            rows = retrieval.staged(rows, f"{self.path}/{out}/made") if change.made else rows
            rows = LAYOUT[name](rows) if name in LAYOUT and not change.placed else rows
            n["rows"] = self._put(rows, f"{out}/rows", number)
            if change.made:
                self._log.delete(f"{self.path}/{out}/made")
        # Before a table's first segment there is nothing that its keys could replace.
        older = self.state.get(name)
        keys = change.keys.select(F.col(change.keys.columns[0]).alias(key)) if change.keys is not None and older else None
        if n["rows"] and not change.covered and older:
            own = self._rows(name, {"path": out, **n}).select(key)
            keys = own if keys is None else keys.unionByName(own)
        if keys is not None:
            n["keys"] = self._put(keys.where(F.col(key).isNotNull()).distinct(), f"{out}/keys", F.count(F.lit(1)))
        return {"path": out, **n}

    def _put(self, rows: DataFrame, folder: str, number: Column) -> int:
        """Write rows; how many they were is observed on the way."""
        seen = Observation()
        rows.observe(seen, number.alias("n")).write.parquet(f"{self.path}/{folder}")
        return seen.get["n"] or 0

    def _publish(self, segments: dict[str, list[dict]], batch: tuple[str, int] | None = None) -> Store:
        """The next state: these tables have these segments, the others stay as they are. batch: of a stream, which is noted in it."""
        state, batches = {**self.state, **segments}, {**self.batches, **dict([batch] if batch else [])}
        self._log.commit(self.version + 1, {"tables": {k: v for k, v in state.items() if v}, "batches": batches})
        return Store(self.spark, self.path, self.version + 1)

    def change(self, **changes: Change) -> Store:
        """Apply changes of some tables as one."""
        folder, new = f"segments/{uuid.uuid4().hex}", {}
        for name, change in changes.items():
            made = self._write(name, change, folder)
            if made["rows"] or made["keys"]:
                new[name] = [*self.state.get(name, []), made]
        return self._publish(new).merge() if new else self

    def ingest(self, docs: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame] | None = None, metadata: DataFrame | None = None, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Store:
        """Files of the same path are replaced, and their postings with them. Metadata that is new wins over old, null keeps it. Chunks go with the
        text they were made from: where the body has changed, and where new ones are given, as rows or as a function of the new files. gone(path, id):
        files that go in the same commit. batch: of a stream, by name and number; one that the store has already is left out."""
        if batch is not None and self.batches.get(batch[0], -1) >= batch[1]:
            return self
        folder = f"segments/{uuid.uuid4().hex}"
        made = self._write("files", Change(docs, None if gone is None else gone.select("path")), folder)
        if not made["rows"] and not made["keys"]:
            return self
        docs = self._read(made["path"], "rows", STORED["files"][0])  # written once, read by all that follows
        before = self.table("files").join(docs.select("path"), "path", "left_semi").select("id")
        ids = before.union(docs.select("id"))
        ids = retrieval.staged((ids if gone is None else ids.union(gone.select("id"))).distinct(), f"{self.path}/{folder}/ids")
        # Texts are taken to words once, for postings and lengths.
        told = docs.withColumn("digest", F.xxhash64(F.coalesce("body", F.lit(""))))
        words = retrieval.staged(retrieval.posting_lists(told), f"{self.path}/{folder}/words")
        lengths = words.where("told is not null").select(F.inline("told")).where("id is not null")
        old = self.table("lengths").select("id", F.col("digest").alias("_old"))
        stale = ids.join(lengths.select("id", "digest"), "id", "left").join(old, "id", "left").where("digest is null or _old is null or digest <> _old").select("id")
        new = metadata if metadata is not None else lib.metadata_rows(docs)
        chunks = chunks(docs) if callable(chunks) else chunks
        known = self.table("metadata").join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        merged = tables.coalesce_merge(known, new, "file_id", list(tables.METADATA)).join(docs.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        grams = lambda: trigram.gram_lists(self._read(f"{folder}/texts", "rows", STORED["texts"][0]))  # noqa: E731 - from the texts that are written then
        changes = {
            "postings": Change(words.where("term is not null").select("term", "rows"), ids, covered=True), "lengths": Change(lengths, ids, covered=True), "metadata": Change(merged, ids, covered=True),
            "chunks": Change(chunks, stale), "texts": Change(trigram.texts(trigram.stored_order(docs)), ids, covered=True, placed=True), "grams": lambda: Change(grams(), ids, covered=True, made=True),
        }
        out = {"files": [*self.state.get("files", []), made]}
        for name, change in changes.items():
            segment = self._write(name, change() if callable(change) else change, folder)
            if segment["rows"] or segment["keys"]:
                out[name] = [*self.state.get(name, []), segment]
        for what in ("words", "ids"):
            self._log.delete(f"{self.path}/{folder}/{what}")
        return self._publish(out, batch).merge()

    def scan(self, *roots: str, parsers: dict | None = None, embed: Callable[[Column], Column] | None = None, metadata: DataFrame | None = None) -> tuple[Store, dict[str, int]]:
        """Bring the library up to date with the files below these roots, or below all registered folders, in one commit; roots that aren't there
        are left alone. (the next state, files scanned, parsed, skipped and removed). Only new and changed files are opened. embed: makes the vectors
        of new texts, if the settings want chunks; their sizes are of the settings too.

        One listing meets the known files once; what differs is written, and the counters are observed in that write."""
        roots = [r.rstrip("/") for r in roots or [f["path"] for f in self.table("folders").collect()]]  # as many as somebody has registered
        roots = [r for r in roots if not sources.mounted(r) or os.path.isdir(r)]
        if not roots:
            return self, dict.fromkeys(("scanned", "parsed", "skipped", "removed"), 0)
        below = reduce(operator.or_, [tables.under(F.col("path"), r) for r in roots])
        known = self.table("files").where(below).select("path", "id", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
        rows = sources.listing(self.spark, *roots).join(known, "path", "full_outer")
        same = F.coalesce((F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size")), F.lit(False))
        rows = rows.select("path", "id", "mtime", "size", F.when(F.col("mtime").isNull(), "removed").when(same, "skipped").otherwise("parsed").alias("what"))
        seen, folder = Observation(), f"segments/{uuid.uuid4().hex}/scan"
        counted = [F.count_if(F.col("what") == w).alias(w) for w in ("parsed", "skipped", "removed")]
        rows.observe(seen, *counted).where("what <> 'skipped'").write.parquet(f"{self.path}/{folder}")
        n = seen.get
        counts = {"scanned": n["parsed"] + n["skipped"], **n}
        if not n["parsed"] and not n["removed"]:
            return self, counts
        found = self._read(folder, "", "path string, id long, mtime long, size long, what string")
        size, overlap, wanted = lib.chunk_settings(self.table("settings"))
        chunks = (lambda docs: lib.chunk_rows(docs, embed, size, overlap)) if embed is not None and wanted else None
        changed = found.where("what = 'parsed'")
        docs = sources.documents(walk.contents(changed.where(F.col("path").startswith("/"))), parsers)
        for root in roots:
            if not sources.mounted(root):
                docs = docs.unionByName(sources.read_documents(self.spark, root, parsers, changed))
        return self.ingest(docs, chunks, metadata, found.where("what = 'removed'").select("path", "id")), counts

    def _without(self, gone: DataFrame) -> Store:
        """gone(path, id): these files go, with all that hangs on them."""
        ids = gone.select("id")
        return self.change(files=Change(keys=gone.select("path")), **{name: Change(keys=ids) for name in ("metadata", "chunks", *INDEX)})

    def delete(self, paths: DataFrame) -> Store:
        return self._without(self.table("files").join(paths.select("path"), "path", "left_semi"))

    def prune(self, root: str, listing: DataFrame) -> Store:
        """Files below root that a complete listing doesn't have go."""
        return self._without(tables.prune_missing(self.table("files"), root, listing)[1])

    def remove_folder(self, root: str, keep_files: bool = False) -> Store:
        root = root.rstrip("/")
        out = self
        if not keep_files:
            inside = tables.under(F.col("path"), root) | (F.col("path") == root)
            out = self._without(self.table("files").where(inside))
        return out.change(folders=Change(keys=self.spark.createDataFrame([(root,)], "path string")))

    def add_folder(self, path: str, added_at: int) -> Store:
        """Folders below it go; it isn't added below a registered one."""
        path, known = path.rstrip("/"), self.table("folders")
        below = known.where(tables.under(F.col("path"), path)).select("path")
        if tables.folder_above(known, path).isEmpty():
            return self.change(folders=Change(self.spark.createDataFrame([(path, added_at)], "path string, added_at long"), below))
        return self

    def set(self, **values: str | None) -> Store:
        """Settings with these values; None deletes one."""
        rows = self.spark.createDataFrame(list(values.items()), lib.TABLES["settings"])
        return self.change(settings=Change(rows.where("value is not null"), rows.select("key")))

    def put_chunks(self, chunks: DataFrame) -> Store:
        """Replace the chunks of the files that these are of."""
        return self.change(chunks=Change(chunks))

    def patch_metadata(self, patch: DataFrame) -> Store:
        """patch(path, some of the metadata), for known paths only."""
        fields = [c for c in tables.METADATA if c in patch.columns]
        own = patch.join(self.table("files").select("path", F.col("id").alias("file_id")), "path").select("file_id", *fields)
        known = self.table("metadata").join(own.select("file_id"), "file_id", "left_semi")
        return self.change(metadata=Change(tables.coalesce_merge(known, own, "file_id", fields)))

    def reset(self) -> Store:
        """An empty library; its earlier states can still be read."""
        return self._publish(dict.fromkeys(self.state, []))

    # Upkeep

    def merge(self, most: int = SEGMENTS) -> Store:
        """Rewrite the newest segments of tables that have more than so many into one, and older ones with them that aren't more than twice as large."""
        folder, new = f"segments/{uuid.uuid4().hex}", {}
        for name, segments in self.state.items():
            if len(segments) <= most:
                continue
            start, size = len(segments), 0
            while start and (len(segments) - start < 2 or segments[start - 1]["rows"] + segments[start - 1]["keys"] <= 2 * size):
                start -= 1
                size += segments[start]["rows"] + segments[start]["keys"]
            part, key = segments[start:], STORED[name][1]
            gone = self._keys(name, list(enumerate(part))) if start else None  # nothing is older than the first segment
            made = self._write(name, Change(self._live(name, part), None if gone is None else gone.select(key), covered=True, made=name in LISTED), folder)
            new[name] = [*segments[:start], made] if made["rows"] or made["keys"] else segments[:start]
        return self._publish(new) if new else self

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the newest states don't name; how many folders went. No other writer may be at work."""
        kept = self._log.versions()[-keep:]
        named = {s["path"].split("/")[1] for v in kept for t in self._log.read(v)["tables"].values() for s in t}
        gone = [f for f in self._log.folders(f"{self.path}/segments") if f not in named]
        for f in gone:
            self._log.delete(f"{self.path}/segments/{f}")
        for v in self._log.versions()[:-keep]:
            self._log.delete(f"{self._log.path}/{v:010d}.json")
        return len(gone)
