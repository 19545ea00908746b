"""The best k by BM25 without scoring every match: documents fall into blocks by a hash of their id, and of each term and block an upper bound is stored.

What a block's documents can score at most is the sum of its terms' bounds. The k blocks with the highest ones are scored first; their kth score
rules out every block that stays below it, so the result is exact. Beside a rare word hardly any block of a frequent one is left. The rows hold
lengths, so no table of lengths is joined, and the corpus' totals are one stored row. Phrases of several words need positions: ``retrieval.keyword``."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as q
from ..functions.text import tokens
from .retrieval import K1, LEAST_IDF, B, fingerprint, pieces, remove, staged, top, word_filter

#: Documents of a block, on average; block numbers up to which they are broadcast.
BLOCK, BROADCAST_BLOCKS = 128, 200_000


def term_rows(files: DataFrame, blocks: int) -> DataFrame:
    """term, block, id, f, length: how often a document has each of its words, in name and body together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 2)):
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            doc, n = np.repeat(np.arange(len(sizes)), sizes), max(1, len(words.dictionary))
            key, f = np.unique(doc * n + words.indices.to_numpy(), return_counts=True)
            at = pa.array(key // n)
            columns = [words.dictionary.take(pa.array(key % n)), batch.column(1).take(at), batch.column(0).take(at), pa.array(f), pa.array(sizes[key // n])]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "block", "id", "f", "length"])

    words = F.concat(tokens(F.col("filename")), tokens(F.col("body")))
    rows = files.select(F.col("id").cast("long").alias("id"), F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(blocks)).cast("long").alias("block"), words.alias("words"))
    return rows.mapInArrow(run, "term string, block long, id long, f long, length long")


@dataclass(frozen=True)
class Ranked:
    rows: DataFrame  # term, block, id, f, length
    blocks: DataFrame  # term, block, f (the highest), length (the least), docs
    docs: int
    mean: float

    @classmethod
    def write(cls, files: DataFrame, path: str, block: int = BLOCK) -> Ranked:
        spark, order = files.sparkSession, ("term", "block")
        known = fingerprint(files).first()  # one row
        rows = staged(term_rows(files, max(1, math.ceil(known["n"] / block))), f"{path}/made")
        # Words are taken from the texts once; the table of totals, which tells that the index is whole, is written last.
        mean = rows.agg(F.sum("f").cast("double").alias("words")).select(F.try_divide(F.coalesce("words", F.lit(0.0)), F.lit(known["n"])).alias("mean"))
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
        cells = spark.read.parquet(f"{path}/rows").groupBy(*order).agg(F.max("f").alias("f"), F.min("length").alias("length"), F.count("*").alias("docs"))
        cells.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/blocks")
        mean.select(F.lit(known["n"]).alias("docs"), "mean", F.lit(known["n"]).alias("n"), F.lit(known["hashes"]).alias("hashes")).write.mode("overwrite").parquet(f"{path}/totals")
        remove(spark, f"{path}/made")
        return cls._read(spark, path)

    @classmethod
    def _read(cls, spark: SparkSession, path: str) -> Ranked:
        totals = spark.read.parquet(f"{path}/totals").first()
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/blocks"), totals["docs"], totals["mean"] or 1.0)

    @classmethod
    def open(cls, files: DataFrame, path: str) -> Ranked:
        """Written anew if it is missing, or of other files than these."""
        spark = files.sparkSession
        try:
            known = spark.read.parquet(f"{path}/totals").select("n", "hashes").first() == fingerprint(files).first()
            return cls._read(spark, path) if known else cls.write(files, path)
        except AnalysisException:  # no such folder
            return cls.write(files, path)

    def _part(self, idf: float, f: Column, length: Column) -> Column:
        return F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(self.mean)))

    def _cells(self, match: q.Match) -> list[DataFrame]:
        """For each phrase: block, f and length that bound it there, docs, and how many of its terms the block has."""
        having = [self.blocks.where(word_filter(words[0], prefix)) for words, prefix in match.phrases]
        return [h.groupBy("block").agg(F.sum("f").alias("f"), F.min("length").alias("length"), F.sum("docs").alias("docs"), F.count("*").alias("terms")) for h in having]

    def _idf(self, match: q.Match, cells: list[DataFrame]) -> list[float]:
        out = []
        for (words, prefix), cell in zip(match.phrases, cells, strict=True):
            n = cell.agg(F.sum(F.when(F.col("terms") == 1, F.col("docs"))).alias("n"), F.count_if(F.col("terms") > 1).alias("more")).first()
            docs = n["n"] or 0
            if n["more"]:  # documents that have two words of the same beginning count once: only ids of such blocks are read
                many = cell.where("terms > 1").select("block")
                ids = self.rows.where(word_filter(words[0], prefix)).select("block", "id")
                docs += ids.join(F.broadcast(many) if n["more"] <= BROADCAST_BLOCKS else many, "block", "left_semi").select("id").distinct().count()
            out.append(max(LEAST_IDF, math.log((self.docs - docs + 0.5) / (docs + 0.5))))
        return out

    def _bounds(self, match: q.Match, cells: list[DataFrame], idf: list[float]) -> DataFrame:
        """block, bound: of blocks where a document may match."""
        out = None
        for i, cell in enumerate(cells):
            rows = cell.select("block", F.lit(i).alias("phrase"), self._part(idf[i], F.col("f"), F.col("length")).alias("part"))
            out = rows if out is None else out.unionByName(rows)
        present = [F.bool_or(F.col("phrase") == i).alias(f"has{i}") for i in range(len(cells))]
        may = q.Match(match.phrases, _positive(match.expression)).column(lambda i: F.col(f"has{i}"))
        return out.groupBy("block").agg(F.sum("part").alias("bound"), *present).where(may).select("block", "bound")

    def _scores(self, match: q.Match, idf: list[float], blocks: DataFrame | list[int]) -> DataFrame:
        """id, score of the matches in these blocks. A document's rows are all in one block."""
        out = None
        for i, (words, prefix) in enumerate(match.phrases):
            rows = self.rows.where(word_filter(words[0], prefix))
            rows = rows.where(F.col("block").isin(blocks)) if isinstance(blocks, list) else rows.join(blocks, "block", "left_semi")
            rows = rows.groupBy("id").agg(F.sum("f").alias("f"), F.min("length").alias("length"))
            rows = rows.select("id", F.lit(i).alias("phrase"), self._part(idf[i], F.col("f"), F.col("length")).alias("part"))
            out = rows if out is None else out.unionByName(rows)
        present = [F.bool_or(F.col("phrase") == i).alias(f"has{i}") for i in range(len(match.phrases))]
        return out.groupBy("id").agg(F.sum("part").alias("score"), *present).where(match.column(lambda i: F.col(f"has{i}"))).select("id", "score")

    def search(self, query: str, k: int) -> tuple[DataFrame, DataFrame]:
        """(id, score of the best k as ``retrieval.top`` of ``retrieval.keyword`` has them; block, bound of the blocks that had to be scored)."""
        none = self.rows.select("id", F.lit(0.0).alias("score")).where("false")
        try:
            match = q.parse(q.normalise(query), q.fold_words)
        except q.QuerySyntaxError:
            return none, self.blocks.select("block", F.lit(0.0).alias("bound")).where("false")
        if any(len(words) > 1 for words, _ in match.phrases):
            raise ValueError("phrases of several words need an index with positions")
        cells = self._cells(match)
        idf = self._idf(match, cells)
        bounds = self._bounds(match, cells, idf)
        lead = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(k).collect()]  # k numbers
        best = [r["score"] for r in top(self._scores(match, idf, lead), k).collect()] if lead else []
        # A bound is a sum in another order than the score that it bounds.
        needed = bounds.where(F.col("bound") >= best[-1] * (1 - 1e-9)) if len(best) == k else bounds
        few = needed.count() <= BROADCAST_BLOCKS
        numbers = needed.select("block")
        return top(self._scores(match, idf, F.broadcast(numbers) if few else numbers), k), needed


def _positive(expression):
    """An expression that holds wherever this one may hold for one of several documents: what must not occur may still occur in others."""
    if isinstance(expression, int):
        return expression
    op, a, b = expression
    return _positive(a) if op == "NOT" else (op, _positive(a), _positive(b))
