"""A library of documents as tables, and the steps from one state to the next. Every step is lazy; save writes a state."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vector as v
from ..operators import legal, tables
from ..sources import files as sources

FILES = ("id", "path", "filename", "ext", "mtime", "size", "body", "status", "error_msg")
TABLES = {
    "files": "id long, path string, filename string, ext string, mtime long, size long, body string, status string, error_msg string",
    "metadata": "file_id long, summary string, tags array<string>, case_number string, case_kind string, court_name string, document_type string, document_date string, plaintiff string, defendant string",
    "chunks": "file_id long, chunk_index int, text string, embedding array<float>",
    "folders": "path string, added_at long",
    "settings": "key string, value string",
}


def chunk_rows(files: DataFrame, embed: Callable[[Column], Column], size: int = 800, overlap: int = 150) -> DataFrame:
    """file_id, chunk_index, text, embedding of the files that have a text. embed: tokens -> vector."""
    rows = files.where("status = 'indexed' and body <> ''").select(F.col("id").alias("file_id"), F.posexplode(t.chunk_text(F.col("body"), size, overlap)).alias("chunk_index", "text"))
    return rows.withColumn("embedding", embed(t.tokens(F.col("text"))))


def chunk_settings(settings: DataFrame) -> tuple[int, int, bool]:
    """(size, overlap, whether chunks are made) as settings have them: chunk_size, chunk_overlap and embeddings_enabled. What isn't a positive number
    counts as not set."""
    known = {r["key"]: r["value"] or "" for r in settings.where(F.col("key").isin("chunk_size", "chunk_overlap", "embeddings_enabled")).collect()}
    number = lambda key, default: int((re.match(r"\s*\+?([0-9]+)", known.get(key, "")) or ("", "0"))[1]) or default
    return number("chunk_size", 800), number("chunk_overlap", 150), known.get("embeddings_enabled") == "true"


def metadata_rows(files: DataFrame) -> DataFrame:
    """What the texts of files say about them; files without a text have no metadata."""
    found = legal.extract_metadata(files.where("body <> ''"))
    empty = {"summary": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>")}
    return found.withColumns(empty).select(F.col("id").alias("file_id"), *tables.METADATA)


@dataclass(frozen=True)
class Library:
    files: DataFrame
    metadata: DataFrame
    chunks: DataFrame
    folders: DataFrame | None = None
    settings: DataFrame | None = None

    def __post_init__(self) -> None:
        for name in ("folders", "settings"):
            if getattr(self, name) is None:
                object.__setattr__(self, name, self.files.sparkSession.createDataFrame([], TABLES[name]))

    @classmethod
    def empty(cls, spark: SparkSession) -> Library:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Library:
        return cls(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()})

    def save(self, path: str) -> Library:
        """Write a state into a folder of its own; a state is never written over the one it is computed from. An unknown status fails it."""
        for name in TABLES:
            rows = tables.checked_status(self.files) if name == "files" else getattr(self, name)
            rows.write.mode("errorifexists").parquet(f"{path}/{name}")
        return Library.load(self.files.sparkSession, path)

    def scan(self, root: str, parsers: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(parsed files that are new or changed, a complete listing)."""
        spark = self.files.sparkSession
        now = sources.listing(spark, root)
        return sources.read_documents(spark, root, parsers, tables.changed(now, self.files)), now

    def ingest(self, docs: DataFrame, chunks: DataFrame | None = None, metadata: DataFrame | None = None) -> Library:
        """Files of the same path are replaced; metadata that is new wins over old, null keeps it. Chunks go with the text they were made from: where
        the body has changed, and where new ones are given."""
        new = metadata if metadata is not None else metadata_rows(docs)
        out = replace(self, files=tables.upsert(self.files, docs.select(*FILES), "path"), metadata=tables.coalesce_merge(self.metadata, new, "file_id", list(tables.METADATA)))
        told = lambda rows, name: rows.select("path", F.col("id").alias(f"{name}_id"), F.xxhash64(F.coalesce("body", F.lit(""))).alias(name))
        stale = told(self.files, "old").join(told(docs, "new"), "path").where("old <> new or old_id <> new_id").select(F.col("old_id").alias("file_id"))
        kept = self.chunks.join(stale, "file_id", "left_anti").select(*self.chunks.columns)
        return replace(out, chunks=kept if chunks is None else tables.upsert(kept, chunks, "file_id"))

    def _kept(self, files: DataFrame) -> Library:
        return replace(self, files=files, metadata=tables.cascade(self.metadata, files), chunks=tables.cascade(self.chunks, files))

    def delete(self, paths: DataFrame) -> Library:
        return self._kept(tables.delete_paths(self.files, paths))

    def prune(self, root: str, listing: DataFrame) -> Library:
        return self._kept(tables.prune_missing(self.files, root, listing)[0])

    def read(self, path: str) -> DataFrame:
        return tables.read_document(self.files, self.metadata, path)

    def list_folders(self) -> DataFrame:
        return self.folders.orderBy("added_at", "path")

    def add_folder(self, path: str, added_at: int) -> tuple[Library, str | None, DataFrame]:
        """(the next state, the registered folder that covers the path already, if any, the folders that go because it covers them)."""
        path = path.rstrip("/")
        above = tables.folder_above(self.folders, path).first()
        pruned = self.folders.where(tables.under(F.col("path"), path)).select("path")
        return replace(self, folders=tables.add_folder(self.folders, path, added_at)), above["path"] if above else None, pruned

    def remove_folder(self, root: str, keep_files: bool = False) -> Library:
        """Its files go with it unless they are kept."""
        out = self if keep_files else self._kept(tables.remove_folder(self.files, root))
        return replace(out, folders=self.folders.where(F.col("path") != root.rstrip("/")))

    def get(self, key: str, default: str | None = None) -> str | None:
        return tables.settings_get(self.settings, [key], default).first()["value"]

    def set(self, **values: str | None) -> Library:
        """Settings with these values; None deletes one."""
        rows = self.files.sparkSession.createDataFrame(list(values.items()), TABLES["settings"])
        return replace(self, settings=tables.upsert(self.settings, rows, "key").where("value is not null"))

    def use_model(self, name: str, embed: Callable[[int], Callable[[Column], Column]], force: bool = False) -> tuple[Library, bool]:
        """(the next state, whether its chunks are made anew). embed: dimensions -> embedder. Chunks are made anew if there are any, and the
        model isn't the one they were made with or it is forced."""
        key = v.model_id(name)
        provider, model, dimensions = v.MODELS[key]
        first = next(iter(v.MODELS))
        rebuild = (force or self.get("indexed_model_id", self.get("active_model_id", first)) != key) and not self.chunks.isEmpty()
        out = self.set(active_model_id=key, active_model=model, embedding_provider=provider, indexed_model_id=key, indexed_model_dim=str(dimensions))
        return (out.rebuild_chunks(embed(dimensions)) if rebuild else out), rebuild

    def enrich(self, answer: Callable[[Column], Column]) -> Library:
        """A model's summary and tags for every document with a text and without a summary, and what its text says. answer: text -> answer."""
        missing = tables.without_summary(self.files.where("trim(body) <> ''"), self.metadata)
        found = sources.llm_fields(legal.extract_metadata(missing).withColumn("_answer", answer(F.col("body"))), "_answer")
        return replace(self, metadata=tables.coalesce_merge(self.metadata, found.select(F.col("id").alias("file_id"), *tables.METADATA), "file_id", list(tables.METADATA)))

    def scan_counts(self, root: str) -> DataFrame:
        return tables.scan_counts(sources.listing(self.files.sparkSession, root), self.files, root)

    def patch_metadata(self, patch: DataFrame) -> Library:
        """patch(path, some of the metadata): for known paths only."""
        fields = [c for c in tables.METADATA if c in patch.columns]
        own = patch.join(self.files.select("path", F.col("id").alias("file_id")), "path").select("file_id", *fields)
        return replace(self, metadata=tables.coalesce_merge(self.metadata, own, "file_id", fields))

    def _sizes(self, size: int | None, overlap: int | None) -> tuple[int, int]:
        if size is None or overlap is None:
            own = chunk_settings(self.settings)
            return own[0] if size is None else size, own[1] if overlap is None else overlap
        return size, overlap

    def rebuild_chunks(self, embed: Callable[[Column], Column], size: int | None = None, overlap: int | None = None) -> Library:
        """All chunks anew, as after a change of the model; sizes that aren't given are those of the settings."""
        return replace(self, chunks=chunk_rows(self.files, embed, *self._sizes(size, overlap)))

    def backfill_chunks(self, embed: Callable[[Column], Column], limit: int | None = None) -> Library:
        """Chunks for files that have none; for the first of them only, if there is a limit."""
        missing = tables.without_chunks(self.files, self.chunks)
        if limit is not None:
            missing = missing.orderBy("id").limit(limit)
        return replace(self, chunks=self.chunks.unionByName(chunk_rows(missing, embed, *self._sizes(None, None))))

    def stats(self, folders: DataFrame | None = None) -> DataFrame:
        return tables.stats(self.folders if folders is None else folders, self.files, self.chunks)
