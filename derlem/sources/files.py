"""Folders of files: which are read, and how each format becomes text."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from . import walk

#: Folders that are never entered (lower case), and extensions that are read.
SKIPPED_DIRS = ("node_modules", ".git", ".svn", ".hg", ".codegraph", "$recycle.bin", "system volume information", ".trash", ".trashes", ".fseventsd", ".spotlight-v100", ".npm", ".pnpm-store", ".yarn", ".cargo", ".rustup", ".venv", "venv", "env", ".cache", "caches", "application support", "containers", "logs", "applications")
EXTENSIONS = (".udf", ".docx", ".doc", ".pdf", ".txt", ".text", ".md")

BINARY = "path string, modificationTime timestamp, length long, content binary"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.[^.]*$", 0))


def skipped_dir(name: Column) -> Column:
    return F.lower(name).isin(*SKIPPED_DIRS) | F.lower(name).endswith(".app") | name.startswith(".")


def skipped_file(name: Column) -> Column:
    low = F.lower(name)
    return name.startswith("~$") | name.startswith("._") | low.endswith(".tmp") | low.isin(".ds_store", "thumbs.db")


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS) & ~skipped_file(basename(path))


def wanted(path: Column, root: str) -> Column:
    """Supported files below root with no skipped folder between."""
    inner = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")
    dirs = F.slice(F.split(inner, "/"), 1, F.size(F.split(inner, "/")) - 1)
    return supported(path) & ~F.exists(dirs, skipped_dir)


def mounted(root: str) -> bool:
    """Whether a root is a path of a mounted file system, and not an address of another one."""
    return root.startswith("/")


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """path, mtime (ms), size of the files below roots that are read; contents aren't touched. Of a mounted file system skipped folders are not opened
    (see sources.walk); of another one everything below the root is listed, then left out. Roots don't contain each other."""
    out = None
    local = [r for r in roots if mounted(r)]
    if local:
        spark.dataSource.register(walk.Walk)
        rows = spark.read.format("derlem_walk").options(roots=json.dumps(local), skipped=json.dumps(SKIPPED_DIRS)).load()
        out = rows.where((F.col("size") > 0) & supported(F.col("path")))
    for root in roots:
        if not mounted(root):
            rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            rows = rows.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size")).where((F.col("size") > 0) & wanted(F.col("path"), root))
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], walk.SCHEMA) if out is None else out


def _zip_member(data: bytes, wanted) -> bytes | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        name = next((n for n in z.namelist() if wanted(n)), None)
        return z.read(name) if name else None


def _udf(data: bytes) -> str:
    """The document's XML: of the archive's first .xml, or the file itself if it is XML."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        xml = _zip_member(data, lambda n: n.endswith(".xml"))
        if xml is not None:
            return xml.decode("utf-8", "replace")
    text = data.decode("utf-8", "replace")
    if text.lstrip().startswith("<") or "CDATA" in text:
        return text
    raise ValueError("no XML in the archive")


def _docx(data: bytes) -> str:
    xml = _zip_member(data, lambda n: n == "word/document.xml")
    if xml is None:
        raise ValueError("no document in the archive")
    text = re.sub(r"<w:tab\b[^>]*/>", "\t", xml.decode("utf-8", "replace"))
    # Words may be split between runs, so tags leave nothing behind.
    return re.sub(r"<[^>]*>", "", re.sub(r"</w:p>|<w:br\b[^>]*/>", "\n\n", text))


#: extension -> bytes to markup or text; .doc and .pdf need a parser from the user.
PARSERS = {".udf": _udf, ".docx": _docx, ".txt": lambda b: b.decode("utf-8", "replace")}
PARSERS |= {".text": PARSERS[".txt"], ".md": PARSERS[".txt"]}


def parse(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """path, content, ... -> adds filename, ext, body, status and error_msg; what can't be read is failed, with an empty body."""
    known = PARSERS | (parsers or {})

    @F.pandas_udf("struct<raw: string, error: string>")
    def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, extensions in batches:
            rows = []
            for data, ext in zip(contents, extensions, strict=True):
                try:
                    if data is None:
                        raise OSError("the file can't be read")
                    if ext not in known:
                        raise ValueError(f"no parser for {ext}")
                    rows.append((known[ext](bytes(data)), None))
                except Exception as e:  # a file that can't be read is a row's state, not the job's
                    rows.append(("", str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["raw", "error"])

    rows = files.withColumn("filename", basename(F.col("path"))).withColumn("ext", extension(F.col("path"))).withColumn("_d", decode("content", "ext"))
    cdata = F.regexp_extract("_d.raw", r"(?is)<!\[CDATA\[(.*?)\]\]>", 1)
    raw = F.when((F.col("ext") == ".udf") & F.col("_d.raw").rlike(r"(?is)<!\[CDATA\[.*?\]\]>"), cdata).otherwise(F.col("_d.raw"))
    return (rows.withColumn("body", clean_text(raw)).withColumn("status", F.when(F.col("_d.error").isNull(), "indexed").otherwise("failed"))
            .withColumn("error_msg", F.col("_d.error")).drop("_d", "content"))


def read_documents(spark: SparkSession, root: str, parsers: dict | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Parsed files below root; of those in paths(path, mtime, size) only, if given: of a mounted file system no other file is opened."""
    if mounted(root):
        rows = walk.contents(listing(spark, root) if paths is None else paths)
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        rows = rows.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
        rows = rows.where((F.col("size") > 0) & wanted(F.col("path"), root))
        if paths is not None:
            rows = rows.join(paths.select("path"), "path", "left_semi")
    return documents(rows, parsers)


def documents(rows: DataFrame, parsers: dict | None = None) -> DataFrame:
    """Rows of files with their content as the files of a library."""
    return parse(rows, parsers).select(F.xxhash64("path").alias("id"), "path", "filename", "ext", "mtime", "size", "body", "status", "error_msg")


def llm_fields(df: DataFrame, answer: str) -> DataFrame:
    """summary and tags from a model's answer: its first JSON object; short summaries and empty tags are dropped, six tags stay."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)\{.*?\}", 0), "summary string, tags array<string>")
    tags = F.filter(F.transform(F.coalesce(found["tags"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    summary = F.trim(found["summary"])
    return df.withColumn("summary", F.when(F.length(summary) > 5, summary)).withColumn("tags", F.slice(tags, 1, 6))
