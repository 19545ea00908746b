"""Maintenance as table-to-table steps: each takes snapshots and returns the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ("pending", "indexed", "failed")
METADATA = ("summary", "tags", "case_number", "case_kind", "court_name", "document_type", "document_date", "plaintiff", "defendant")


def latest_wins(log: DataFrame, key: str | list[str], *version: str) -> DataFrame:
    """The last row of each key. As an aggregate, so that a key's rows are reduced before they are shuffled."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("last"))
    return last.select(*keys, "last.*").select(*log.columns)


def upsert(base: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """changes replace base rows of the same key."""
    return base.join(changes.select(key), key, "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def coalesce_merge(base: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that the patch has replace the base's; null keeps them; keys that only the patch has are new."""
    new = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    return base.join(new, key, "full_outer").select(*[c if c not in fields else F.coalesce(f"_new_{c}", c).alias(c) for c in base.columns])


def under(path: Column, root: str) -> Column:
    return path.startswith(root.rstrip("/") + "/")


def delete_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths, "path", "left_anti").select(*files.columns)


def cascade(children: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Children of files that are still there."""
    return children.join(files.select(F.col("id").alias(key)), key, "left_semi").select(*children.columns)


def prune_missing(files: DataFrame, root: str, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): rows under root whose path wasn't seen go. seen must be a complete listing."""
    gone = files.where(under(F.col("path"), root)).join(seen.select("path"), "path", "left_anti")
    return files.join(gone.select("path"), "path", "left_anti").select(*files.columns), gone.select(*files.columns)


def changed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files that aren't known with the same time and size."""
    return listing.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti").select(*listing.columns)


def collapse_folders(folders: DataFrame) -> DataFrame:
    """Folders that no other one contains. Every path looks its ancestors up by equality, so there is no comparison of all pairs."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = folders.select("path", F.explode(above).alias("above")).where("above <> path and above <> ''")
    nested = ancestors.join(folders.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return folders.join(nested, "path", "left_anti").select(*folders.columns)


def folder_above(folders: DataFrame, path: str) -> DataFrame:
    """The registered folder that contains a path, or is it; folders never contain each other, so it is one row at most."""
    path = path.rstrip("/")
    return folders.where(F.col("path").isin([path[:i] for i, c in enumerate(path) if c == "/" and i] + [path]))


def add_folder(folders: DataFrame, path: str, added_at: int) -> DataFrame:
    """Register a folder; ones below it go, and it isn't added below a registered one. One plan: nothing is looked at before."""
    path = path.rstrip("/")
    row = folders.sparkSession.createDataFrame([(path, added_at)], "path string, added_at long")
    covered = folder_above(folders, path).select(F.lit(path).alias("path"))
    return folders.where(~under(F.col("path"), path)).unionByName(row.join(covered, "path", "left_anti"))


def remove_folder(files: DataFrame, root: str) -> DataFrame:
    """Files outside a folder, and not the path itself."""
    return files.where(~(under(F.col("path"), root) | (F.col("path") == root.rstrip("/"))))


def stats(folders: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts."""
    f = files.agg(F.count("*").alias("total_files"), F.count_if(F.col("status") == "indexed").alias("indexed_files"))
    return f.crossJoin(folders.agg(F.count("*").alias("folders"))).crossJoin(chunks.agg(F.count("*").alias("chunks")))


def without_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = files.where((F.col("status") == "indexed") & (F.col("body") != ""))
    return rows.join(chunks.select(F.col("file_id").alias("id")), "id", "left_anti").select(*files.columns)


def without_summary(files: DataFrame, metadata: DataFrame) -> DataFrame:
    have = metadata.where("summary is not null and summary <> ''").select(F.col("file_id").alias("id"))
    return files.join(have, "id", "left_anti").select(*files.columns)


def read_document(files: DataFrame, metadata: DataFrame, path: str) -> DataFrame:
    """The document of a path with its metadata, null if it has none; no rows for an unknown path."""
    return files.where(F.col("path") == path).join(metadata.withColumnRenamed("file_id", "id"), "id", "left")


def settings_get(settings: DataFrame, keys: list[str], default: str | None = None) -> DataFrame:
    """key, value for each key asked for; the default where it isn't set."""
    asked = settings.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return asked.join(settings, "key", "left").select("key", F.coalesce("value", F.lit(default).cast("string")).alias("value"))


def scan_counts(listing: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """One row for a scan of a folder: files scanned, parsed (new or changed), skipped (known as they are) and removed."""
    old = known.where(under(F.col("path"), root)).select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_old"))
    rows = listing.select("path", "mtime", "size", F.lit(True).alias("_new")).join(old, "path", "full_outer")
    same = F.coalesce((F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s")), F.lit(False))
    return rows.agg(F.count("_new").alias("scanned"), F.count_if(F.col("_new") & ~same).alias("parsed"), F.count_if(F.col("_new") & same).alias("skipped"), F.count_if(F.col("_new").isNull()).alias("removed"))


def json_rows(rows: DataFrame) -> DataFrame:
    """Each row as a line of JSON, ready for ``write.text``; null fields are kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def facet(rows: DataFrame, document_type: str | None = None, case_kind: str | None = None) -> DataFrame:
    """document_type contains, in Turkish lower case; case_kind equals, in upper case."""
    from ..functions.text import tr_lower

    if document_type:
        rows = rows.where(F.contains(tr_lower(F.coalesce("document_type", F.lit(""))), tr_lower(F.lit(document_type))))
    if case_kind:
        rows = rows.where(F.upper(F.coalesce("case_kind", F.lit(""))) == case_kind.upper())
    return rows


def fold_changes(feed: DataFrame, key: str, removed: Column, *version: str) -> DataFrame:
    """The state after a change feed: each key's last change, without keys whose last change removes them."""
    return latest_wins(feed.withColumn("_removed", removed), key, *version).where("not _removed").drop("_removed")


def checked_status(files: DataFrame) -> DataFrame:
    """Fails where a status isn't known."""
    return files.withColumn("status", F.when(F.col("status").isin(*STATUS), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null")))).cast("string")))


