"""Searches from the query string to the rows that are shown: one lazy plan for each search.

Ranked lists are cut to a bounded number of rows before anything is attached to them, so texts, metadata and snippets are only looked up
for rows that may be shown."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query as q
from ..functions.text import with_snippet
from ..operators import retrieval as r
from ..operators import tables, trigram

MODES = ("keyword", "infix", "semantic", "hybrid")
ALIASES = {"trigram": "infix"}
LIMIT, FACET_FETCH, LEAST_INFIX, SNIPPET = 20, 200, 3, 180
#: Lists of up to so many rows are broadcast; longer ones, which only a very large limit gives, are joined by a shuffle.
BROADCAST_LIST = 10_000


@dataclass(frozen=True)
class SearchResponse:
    """results: id, path, filename, snippet, score, metadata, best first. degraded: the search wasn't what was asked for, and why."""

    query: str
    mode: str
    results: DataFrame
    degraded: bool = False
    reason: str | None = None


@dataclass(frozen=True)
class SearchEngine:
    """files(id, path, filename, body), metadata(file_id, document_type, case_kind, ...), chunks(file_id, chunk_index, text, embedding).

    embedder: query -> vector; without it, or without chunks, semantic searches fall back to keywords. index and lengths: written by
    retrieval.write_index; without them postings are computed in the plan. grams and texts: written by trigram.write_index; without them
    substring searches are scans."""

    files: DataFrame
    metadata: DataFrame
    chunks: DataFrame | None = None
    embedder: Callable[[str], Sequence[float]] | None = None
    index: DataFrame | None = None
    lengths: DataFrame | None = None
    grams: DataFrame | None = None
    texts: DataFrame | None = None

    @classmethod
    def stored(cls, files: DataFrame, metadata: DataFrame, path: str, chunks: DataFrame | None = None, embedder: Callable[[str], Sequence[float]] | None = None) -> SearchEngine:
        """Over the indexes below path, which are written if they are missing or of other files."""
        return cls(files, metadata, chunks, embedder, *r.open_index(files, path), *trigram.open_index(files, f"{path}/trigrams"))

    def search(self, query: str | None, mode: str = "keyword", limit: int | None = LIMIT, document_type: str | None = None, case_kind: str | None = None) -> SearchResponse:
        query, limit, mode = (query or "").strip(), limit if limit and limit > 0 else LIMIT, ALIASES.get(mode, mode)
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if mode == "infix":
            return self._infix(query, limit)
        vector, reason = self._vector(query) if mode != "keyword" else (None, None)
        used = "keyword" if reason else mode
        facets = bool(document_type or case_kind)
        wide = max(20 * limit, FACET_FETCH)
        rows = self._lists(query, used, vector, wide if facets else 2 * limit)
        order = [F.desc("score"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("sem_rank"), "id"]
        kept = wide if facets else limit
        rows = self._with_metadata(rows.orderBy(*order).limit(kept), kept)
        if facets:
            rows = tables.facet(rows.select("*", "metadata.document_type", "metadata.case_kind"), document_type, case_kind).orderBy(*order).limit(limit)
        rows = self._with_files(rows, kept)
        words = self._words(query) if used != "semantic" else []
        found = r.fts_snippet(rows, "body", words, "_found") if words else rows.withColumn("_found", F.lit(""))
        found = found.withColumn("snippet", F.coalesce(F.when(F.col("fts_rank").isNotNull(), F.nullif("_found", F.lit(""))), "text"))
        return SearchResponse(query, used, found.orderBy(*order).select("id", "path", "filename", "snippet", "score", "metadata"), reason is not None, reason)

    def _infix(self, query: str, limit: int) -> SearchResponse:
        """Facets don't apply to it."""
        needle = r.infix_query(query)
        if len(needle) < LEAST_INFIX:
            none = self._with_metadata(r.infix(self.files, "").where("false"), limit)
            none = self._with_files(none, limit).withColumn("snippet", F.lit(""))
            return SearchResponse(query, "infix", none.select("id", "path", "filename", "snippet", "score", "metadata"), True, f"a substring needs {LEAST_INFIX} characters or more")
        found = r.infix(self.files, query) if self.grams is None else trigram.infix(self.grams, self.texts, query)
        rows = self._with_files(self._with_metadata(r.top(found, limit), limit), limit)
        rows = with_snippet(rows, "body", needle, budget=SNIPPET).withColumn("snippet", F.coalesce(F.nullif("snippet", F.lit("")), "filename"))
        return SearchResponse(query, "infix", rows.orderBy(F.desc("score"), "id").select("id", "path", "filename", "snippet", "score", "metadata"))

    def _vector(self, query: str) -> tuple[Sequence[float] | None, str | None]:
        if self.embedder is None or self.chunks is None:
            return None, "embeddings are off"
        try:
            return self.embedder(query), None
        except Exception as e:  # a model that can't be reached leaves the words to search for
            return None, f"the query can't be embedded: {e}"

    def _words(self, query: str) -> list[tuple[str, bool]]:
        try:
            phrases = q.parse(q.normalise(query), q.fold_words).phrases
        except q.QuerySyntaxError:
            return []
        return [(w, prefix and j == len(words) - 1) for words, prefix in phrases for j, w in enumerate(words)]

    def _lists(self, query: str, mode: str, vector: Sequence[float] | None, fetch: int) -> DataFrame:
        """id, score, fts_rank, sem_rank, text (of the best chunk): the first rows of each list, fused if there are two."""
        none = F.lit(None)
        if mode != "semantic":
            index = self.index if self.index is not None else r.postings(self.files)
            lengths = self.lengths if self.lengths is not None else r.doc_lengths(self.files)
            words = r.ranked(r.keyword(index, lengths, query), fetch)
        if mode != "keyword":
            near = r.ranked(r.semantic(self.chunks, F.array(*[F.lit(float(x)) for x in vector])), fetch)
        if mode == "keyword":
            return words.select("id", "score", F.col("rank").alias("fts_rank"), none.cast("int").alias("sem_rank"), none.cast("string").alias("text"))
        if mode == "semantic":
            return near.select("id", "score", none.cast("int").alias("fts_rank"), F.col("rank").alias("sem_rank"), "text")
        return r.fuse(words, near).join(near.select("id", "text"), "id", "left")

    def _small(self, rows: DataFrame, most: int) -> DataFrame:
        return F.broadcast(rows) if most <= BROADCAST_LIST else rows

    def _with_metadata(self, rows: DataFrame, most: int) -> DataFrame:
        fields = F.struct(*[c for c in self.metadata.columns if c != "file_id"]).alias("metadata")
        own = self.metadata.select(F.col("file_id").alias("id"), fields).join(self._small(rows.select("id"), most), "id", "left_semi")
        return rows.join(self._small(own, most), "id", "left")

    def _with_files(self, rows: DataFrame, most: int) -> DataFrame:
        return self.files.select("id", "path", "filename", "body").join(self._small(rows, most), "id")
