"""Substring search from an index: which documents have which three characters in a row, and the normalised texts themselves.

A document that has the query has all its trigrams. The rarest of them are intersected, starting from the rarest, and only the documents that are
left are read and compared. Postings are stored in order of trigrams and texts in order of ids, so row groups of other trigrams and ids are
skipped. A trigram's row has a list of documents, as many as a piece of the table has, so there are far fewer rows to sort than
trigrams of documents. Documents and scores are those of ``retrieval.infix``, which scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tr_lower
from . import retrieval

#: Trigrams of a query that are intersected. More rarely leave fewer documents, and each is one more list to read.
RAREST = 4
#: Postings of the rarest trigram up to which its documents are broadcast; documents up to which the scan of texts is given their ids.
BROADCAST_IDS, NAMED_IDS = 20_000, 200
#: Rows that are put into lists together in a task's Python; a document's own are never split.
BATCH = 1_000_000
#: How trigrams are stored.
LISTS = "gram string, ids array<long>"


def texts(files: DataFrame) -> DataFrame:
    """id, filename_tr, body_tr, length (trigrams of both), to be stored."""
    rows = retrieval.with_normalised(files)
    grams = lambda c: F.greatest(F.lit(0), F.length(c) - 2)
    return rows.select(F.col("id").cast("long").alias("id"), "filename_tr", "body_tr", (grams("filename_tr") + grams("body_tr")).cast("long").alias("length"))


def gram_lists(texts: DataFrame) -> DataFrame:
    """gram, ids: for each trigram the documents of a piece of the table that have it, in order; made where the texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.unique(np.concatenate([_keys(batch.column(c)[i].as_py()) for c in (1, 2)]))
                made.append(keys)
                owners.append(np.full(len(keys), batch.column(0)[i].as_py(), dtype=np.int64))
                size += len(keys)
                if size >= BATCH:
                    yield _listed(np.concatenate(made), np.concatenate(owners))
                    made.clear(), owners.clear()
                    size = 0
        if size:
            yield _listed(np.concatenate(made), np.concatenate(owners))

    return texts.select("id", "filename_tr", "body_tr").mapInArrow(run, LISTS)


def _keys(text: str) -> np.ndarray:
    """Each three characters in a row as one number of 63 bits."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _listed(keys: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    grams = [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in keys[first].tolist()]
    ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), pa.array(owners))
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), ids], names=["gram", "ids"])


def packed(rows: DataFrame) -> DataFrame:
    """gram, ids of rows(gram, id): those that stand together in a task share a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grams = batch.column(0).dictionary_encode()
                codes, ids = grams.indices.to_numpy(), batch.column(1).to_numpy()
                order = np.lexsort((ids, codes))
                codes, ids = codes[order], ids[order]
                first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([grams.dictionary.take(pa.array(codes[first])), lists], names=["gram", "ids"])

    return rows.select("gram", "id").mapInArrow(run, LISTS)


def gram_rows(lists: DataFrame) -> DataFrame:
    """gram, id of lists: one row for each of a document's different trigrams. A filter on gram is one of the lists'."""
    return lists.select("gram", F.explode("ids").alias("id"))


def stored_grams(lists: DataFrame) -> DataFrame:
    """By gram and first id: the lists of a trigram that most documents have are spread over several tasks."""
    order = ("gram", F.col("ids")[0])
    return lists.repartitionByRange(*order).sortWithinPartitions(*order)


def stored_order(files: DataFrame) -> DataFrame:
    """In order of ids, before texts are normalised: the order's bounds are then taken from rows that cost nothing to make."""
    return files.repartitionByRange("id").sortWithinPartitions("id")


def write_index(files: DataFrame, path: str) -> None:
    spark, made = files.sparkSession, f"{path}/made"
    texts(stored_order(files)).write.mode("overwrite").parquet(f"{path}/texts")
    stored_grams(retrieval.staged(gram_lists(spark.read.parquet(f"{path}/texts")), made)).write.mode("overwrite").parquet(f"{path}/grams")
    retrieval.remove(spark, made)
    retrieval.fingerprint(files).write.mode("overwrite").parquet(f"{path}/fingerprint")


def open_index(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(grams, texts) below path; written anew if they are missing or of other files than these. The fingerprint is written last."""
    spark = files.sparkSession
    try:
        whole = spark.read.parquet(f"{path}/fingerprint").first() == retrieval.fingerprint(files).first()
    except AnalysisException:  # no such folder
        whole = False
    if not whole:
        write_index(files, path)
    return gram_rows(spark.read.parquet(f"{path}/grams")), spark.read.parquet(f"{path}/texts")


def _among(ids: list[int]) -> Column:
    """Lists of ten ids, which the scan compares with each row group's least and greatest; of a longer one it only takes the ends."""
    out = F.lit(False)
    for i in range(0, len(ids), 10):
        out = out | F.col("id").isin(ids[i : i + 10])
    return out


def candidates(grams: DataFrame, needle: str) -> tuple[DataFrame, int]:
    """(ids of documents that have the needle's rarest trigrams, how many they are at most). Asks for the lengths of the needle's lists first."""
    wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    sizes = {r["gram"]: r["n"] for r in grams.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row for each at most
    if len(sizes) < len(wanted):
        return grams.select("id").where("false"), 0
    rarest = sorted(wanted, key=lambda g: (sizes[g], g))[:RAREST]
    most = sizes[rarest[0]]
    out = grams.where(F.col("gram") == rarest[0]).select("id")
    for gram in rarest[1:]:  # the shorter list is the one that is sent, whichever way
        out = grams.where(F.col("gram") == gram).select("id").join(F.broadcast(out) if most <= BROADCAST_IDS else out, "id", "left_semi")
    return out, most


def infix(grams: DataFrame, texts: DataFrame, query: str) -> DataFrame:
    """id, score as of ``retrieval.infix``. A query of less than three characters has no trigram: texts are scanned."""
    needle = texts.sparkSession.range(1).select(tr_lower(F.lit(retrieval.infix_query(query)))).first()[0]
    rows = texts
    if len(needle) > 2:
        found, most = candidates(grams, needle)
        few = found.limit(NAMED_IDS + 1).collect() if most else []  # no more than that many numbers
        if len(few) <= NAMED_IDS:
            rows = texts.where(_among(sorted(r["id"] for r in few)))
        else:
            rows = texts.join(F.broadcast(found) if most <= BROADCAST_IDS else found, "id", "left_semi")
    hits = retrieval.infix_hits(rows, F.lit(needle))
    corpus = texts.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    return retrieval.infix_scores(hits, corpus.crossJoin(hits.agg(F.count("*").alias("n"))))  # one row each
