"""Retrievers over files(id, path, filename, body) and chunks(file_id, chunk_index, text, embedding).

The keyword index is a table of postings. A query only touches the postings of its terms: written in order of terms, whole row groups
are skipped; computed on the fly, the filter on terms moves below the grouping."""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as q
from ..functions.text import search_form, spaced, tokens, tr_lower
from ..functions.vector import cosine

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
RRF = 60
LEAST_SIMILARITY = 0.1
#: Postings, and places in them, up to which the rarest word of a phrase is broadcast.
PHRASE_ROWS, PHRASE_PLACES = 20_000, 500_000
#: Words (or characters) that are grouped at once in a task's Python; a document's own are never split.
PIECE = 250_000
#: Bytes of texts whose words are put into lists together.
LISTED = 6_000_000
#: How a store has its postings: a term's row has those of several documents.
LISTS = "term string, rows array<struct<id:bigint,col:int,positions:array<int>>>"
#: What a document's text is known by later: how many words, and a digest that is given.
TOLD = "array<struct<id:bigint,length:bigint,digest:bigint>>"
_ROW = pa.struct([("id", pa.int64()), ("col", pa.int32()), ("positions", pa.list_(pa.int32()))])
_TOLD = pa.list_(pa.struct([("id", pa.int64()), ("length", pa.int64()), ("digest", pa.int64())]))


def postings(files: DataFrame) -> DataFrame:
    """term, id, col (0 filename, 1 body), positions."""
    columns = F.array(F.struct(F.lit(0).alias("col"), tokens(F.col("filename")).alias("words")), F.struct(F.lit(1).alias("col"), tokens(F.col("body")).alias("words")))
    rows = files.select("id", F.explode(columns).alias("c")).select("id", F.col("c.col").alias("col"), F.posexplode("c.words").alias("p", "term"))
    return rows.groupBy("term", "id", "col").agg(F.sort_array(F.collect_list("p")).alias("positions"))


def pieces(batch: pa.RecordBatch, *sized: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about PIECE words, so that memory doesn't grow with the documents of a batch. sized: its columns of lists."""
    return _slices(batch, sum(pc.coalesce(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in sized), PIECE)


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def posting_rows(files: DataFrame) -> DataFrame:
    """The same rows, to be stored: a document's words are grouped where it is read, so no token is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 1, 2)):
            for col in (0, 1):
                lists = batch.column(col + 1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = lists.flatten().dictionary_encode()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = doc * max(1, len(words.dictionary)) + words.indices.to_numpy()
                order = np.argsort(key, kind="stable")  # places stay in order
                key = key[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
                at, offsets = order[first], pa.array(np.append(first, len(key)).astype(np.int32))
                columns = [words.dictionary.take(words.indices.take(pa.array(at))), batch.column(0).take(pa.array(doc[at])), pa.array(np.full(len(at), col, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(place[order].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "col", "positions"])

    words = files.select(F.col("id").cast("long").alias("id"), tokens(F.col("filename")).alias("name"), tokens(F.col("body")).alias("body"))
    return words.mapInArrow(run, "term string, id long, col int, positions array<int>")


def _starts(key: np.ndarray) -> np.ndarray:
    """Where a value of a sorted array stands first."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)


def _lists(terms: pa.Array, codes: np.ndarray, rows: pa.StructArray) -> tuple[pa.Array, pa.Array]:
    """(terms, their lists of rows) of rows in order of codes."""
    first = _starts(codes)
    return terms.take(pa.array(codes[first])), pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)).astype(np.int32)), rows)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of texts that have blanks between them, which text each is of)."""
    parts = pc.split_pattern(texts, " ")
    words, own = parts.flatten(), np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy().astype(np.int64))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), own[some.to_numpy(zero_copy_only=False)]


def posting_lists(files: DataFrame) -> DataFrame:
    """term, rows, told: the same postings of files(id, filename, body, digest) as lists, those of a piece of the table in each, so there are far
    fewer rows to sort. A row without a term has what is told of the piece's documents, so no text is taken to words twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "rows", "told"]
        bytes_of = lambda whole: sum(pc.binary_length(whole.column(c)).to_numpy().astype(np.int64) for c in (2, 3))
        for batch in (part for whole in batches for part in _slices(whole, bytes_of(whole), LISTED)):
            n, ids = batch.num_rows, batch.column(0)
            rank = np.empty(n, dtype=np.int64)
            rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(n)
            of_names, of_bodies = (_split(batch.column(c)) for c in (2, 3))
            owners = [of_names[1], of_bodies[1]]
            sizes = [np.bincount(o, minlength=n) for o in owners]
            told = pa.StructArray.from_arrays([ids, pa.array(sizes[0] + sizes[1]), batch.column(1)], fields=list(_TOLD.value_type))
            ends = pa.array([0, n], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(_ROW)), pa.ListArray.from_arrays(ends, told)], names=names)
            words = pa.concat_arrays([of_names[0], of_bodies[0]]).dictionary_encode()
            doc = np.concatenate(owners)
            place = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
            col = np.repeat([0, 1], [s.sum() for s in sizes])
            key = (words.indices.to_numpy().astype(np.int64) * n + rank[doc]) * 2 + col
            order = np.argsort(key, kind="stable")  # places stay in order
            key = key[order]
            first = _starts(key)
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
            rows = pa.StructArray.from_arrays([ids.take(pa.array(doc[order[first]])), pa.array((key[first] % 2).astype(np.int32)), positions], fields=list(_ROW))
            terms, lists = _lists(words.dictionary, key[first] // (2 * n), rows)
            yield pa.RecordBatch.from_arrays([terms, lists, pa.nulls(len(terms), _TOLD)], names=names)

    words = files.select(F.col("id").cast("long").alias("id"), "digest", spaced(F.col("filename")).alias("name"), spaced(F.col("body")).alias("body"))
    return words.mapInArrow(run, f"{LISTS}, told {TOLD}")


def packed(rows: DataFrame) -> DataFrame:
    """term, rows of postings: those that stand together in a task share a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                terms = batch.column(0).dictionary_encode()
                codes = terms.indices.to_numpy()
                order = np.lexsort((batch.column(2).to_numpy(), pc.fill_null(batch.column(1), 0).to_numpy(), codes))
                part = batch.take(pa.array(order))
                lists = _lists(terms.dictionary, codes[order], pa.StructArray.from_arrays([part.column(c) for c in (1, 2, 3)], fields=list(_ROW)))
                yield pa.RecordBatch.from_arrays(list(lists), names=["term", "rows"])

    return rows.select("term", "id", "col", "positions").mapInArrow(run, LISTS)


def list_rows(lists: DataFrame) -> DataFrame:
    """term, id, col, positions of lists. A filter on term is one of the lists'."""
    return lists.select("term", F.inline("rows"))


def stored_lists(lists: DataFrame) -> DataFrame:
    """By term and first id: the lists of a word that most documents have are spread over several tasks."""
    order = ("term", F.col("rows")[0]["id"])
    return lists.repartitionByRange(*order).sortWithinPartitions(*order)


def doc_lengths(files: DataFrame) -> DataFrame:
    return files.select("id", (F.size(tokens(F.col("filename"))) + F.size(tokens(F.col("body")))).cast("long").alias("length"))


def staged(rows: DataFrame, path: str) -> DataFrame:
    """The rows from a table at path: an order by ranges reads its input twice, once for their bounds, and what is dear to make is made once so."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored_postings(rows: DataFrame) -> DataFrame:
    """By term and id: the postings of a word that most documents have are spread over several tasks."""
    return rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def write_index(files: DataFrame, path: str) -> None:
    """Postings in order of terms, and lengths, as tables below path."""
    made = f"{path}/made"
    stored_postings(staged(posting_rows(files), made)).write.mode("overwrite").parquet(f"{path}/postings")
    remove(files.sparkSession, made)
    doc_lengths(files).write.mode("overwrite").parquet(f"{path}/lengths")
    fingerprint(files).write.mode("overwrite").parquet(f"{path}/fingerprint")


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fingerprint(files: DataFrame) -> DataFrame:
    """One row that tells tables of files apart: by their id, path, time and size where there are a time and a size, else by their texts."""
    told = ("id", "path", "filename", "mtime", "size") if {"mtime", "size"} <= set(files.columns) else ("id", "path", "filename", "body")
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*[c for c in told if c in files.columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hashes"))


def open_index(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) below path; written anew if they are missing, empty while there are files, or of other files than these.

    For a library that changes, plans.store keeps the index in step without writing it anew."""
    spark = files.sparkSession
    read = lambda: (spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))
    try:
        index, lengths = read()
        whole = not lengths.isEmpty() and not index.isEmpty() or files.isEmpty()
        whole = whole and spark.read.parquet(f"{path}/fingerprint").first() == fingerprint(files).first()
    except AnalysisException:  # no such folder
        whole = False
    if not whole:
        write_index(files, path)
        index, lengths = read()
    return index, lengths


def word_filter(word: str, prefix: bool) -> Column:
    term = F.col("term")
    return (term >= word) & (term < word + "\U0010ffff") & term.startswith(word) if prefix else term == word


def _phrase(index: DataFrame, words: list[str], prefix: bool) -> DataFrame:
    """id, f of several words in a row: from the rarest word on, places where the phrase may begin are kept if the next word stands in its own.

    Asks for the lengths of the words' lists first. The rarest one's places are broadcast if they are few, and then nothing else is shuffled."""
    having = [word_filter(w, prefix and j == len(words) - 1) for j, w in enumerate(words)]
    sizes = index.where(reduce(operator.or_, having)).agg(*[F.count_if(h).alias(str(j)) for j, h in enumerate(having)]).first()
    order = sorted(range(len(words)), key=lambda j: (sizes[j], j))
    begins = lambda j, name: index.where(having[j]).select("id", "col", F.transform("positions", lambda p: p - j).alias(name))
    out = begins(order[0], "at")
    few = sizes[order[0]] <= PHRASE_ROWS and (out.agg(F.sum(F.size("at")).alias("n")).first()["n"] or 0) <= PHRASE_PLACES
    for j in order[1:]:
        out = begins(j, "_next").join(F.broadcast(out) if few else out, ["id", "col"])
        out = out.select("id", "col", F.array_intersect("at", "_next").alias("at")).where(F.size("at") > 0)
    return out.select("id", F.size("at").alias("f"))


def phrase_hits(index: DataFrame, match: q.Match) -> DataFrame:
    """id, phrase (its number), f: how often each document has each phrase."""
    out = None
    for i, (words, prefix) in enumerate(match.phrases):
        one = lambda: index.where(word_filter(words[0], prefix)).select("id", F.size("positions").alias("f"))  # noqa: B023, E731
        rows = one() if len(words) == 1 else _phrase(index, list(words), prefix)
        rows = rows.groupBy("id").agg(F.sum("f").alias("f")).select("id", F.lit(i).alias("phrase"), "f")
        out = rows if out is None else out.unionByName(rows)
    return out


def keyword(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """id, score: BM25 over both columns of the documents that the query matches; none if it isn't valid."""
    try:
        match = q.parse(q.normalise(query), q.fold_words)
    except q.QuerySyntaxError:
        return lengths.select("id", F.lit(0.0).alias("score")).where("false")
    hits = phrase_hits(index, match)
    having = hits.groupBy("phrase").agg(F.count("*").alias("n"))  # a row for each phrase of the query
    corpus = lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))  # one row
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(F.broadcast(having), "phrase").join(lengths, "id").crossJoin(F.broadcast(corpus)).withColumn("part", part)
    present = [F.bool_or(F.col("phrase") == i).alias(f"has{i}") for i in range(len(match.phrases))]
    return scored.groupBy("id").agg(F.sum("part").alias("score"), *present).where(match.column(lambda i: F.col(f"has{i}"))).select("id", "score")


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    return scored.orderBy(F.desc(score), "id").limit(k)


def infix_query(query: str) -> str:
    """Composed, quotes to blanks, blanks collapsed; the Turkish lower case is taken in the plan."""
    return " ".join(unicodedata.normalize("NFC", query).replace('"', " ").replace("'", " ").split())


def with_normalised(files: DataFrame) -> DataFrame:
    """files with filename_tr and body_tr, to be stored: substring searches then read these and normalise nothing."""
    return files.withColumns({f"{c}_tr": search_form(F.coalesce(c, F.lit(""))) for c in ("filename", "body")})


def infix_hits(rows: DataFrame, needle: Column) -> DataFrame:
    """id, length, f of the rows(id, filename_tr, body_tr, length) that have the needle; f: how often."""
    # Places are counted by looking ahead, so that matches may overlap; a lower-case needle can't end the quotation.
    ahead = F.concat(F.lit(r"(?=\Q"), needle, F.lit(r"\E)"))
    times = lambda c: F.when(F.contains(F.col(c), needle), F.regexp_count(c, ahead)).otherwise(0)
    return rows.select("id", "length", (times("filename_tr") + times("body_tr")).alias("f")).where("f > 0")


def infix_scores(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, score: BM25 over character trigrams. corpus: one row of docs, mean length and n, the number of hits."""
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.crossJoin(F.broadcast(corpus)).select("id", score.alias("score"))


def infix(files: DataFrame, query: str) -> DataFrame:
    """id, score: documents whose name or body has the query as a substring. A scan; operators.trigram has an index for it."""
    rows = files if {"filename_tr", "body_tr"} <= set(files.columns) else with_normalised(files)
    grams = lambda c: F.greatest(F.lit(0), F.length(c) - 2)
    rows = rows.select("id", "filename_tr", "body_tr", (grams("filename_tr") + grams("body_tr")).alias("length"))
    hits = infix_hits(rows, tr_lower(F.lit(infix_query(query))))
    corpus = rows.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    return infix_scores(hits, corpus.crossJoin(hits.agg(F.count("*").alias("n"))))  # one row each


def semantic(chunks: DataFrame, vector: Column) -> DataFrame:
    """id, score, text: files by their best chunk's cosine, above the least similarity; ties of chunks go to the first."""
    rows = chunks.select(F.col("file_id").alias("id"), "chunk_index", "text", cosine(F.col("embedding"), vector).alias("s"))
    best = rows.groupBy("id").agg(F.max("s").alias("score"), F.max_by("text", F.struct("s", -F.col("chunk_index"))).alias("text"))
    return best.where(F.col("score") > LEAST_SIMILARITY)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The first k with their rank. The window is over k rows."""
    from pyspark.sql import Window

    return top(scored, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(keyword_ranks: DataFrame, semantic_ranks: DataFrame) -> DataFrame:
    """id, score, fts_rank, sem_rank: reciprocal rank fusion of two short lists."""
    a = keyword_ranks.select("id", F.col("rank").alias("fts_rank"))
    b = semantic_ranks.select("id", F.col("rank").alias("sem_rank"))
    part = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", (part("fts_rank") + part("sem_rank")).alias("score"), "fts_rank", "sem_rank")


def fts_snippet(df: DataFrame, body: str, words: list[tuple[str, bool]], out: str = "snippet", width: int = 25) -> DataFrame:
    """The window of width tokens, from a match on, with most matches, matches marked; else the first tokens."""
    parts = F.filter(F.split(F.coalesce(body, F.lit("")), r"(?U)\s+"), lambda t: t != "")
    hit = lambda t: F.exists(tokens(t), lambda w: _any(w, words))
    df = df.withColumn("_p", parts).withColumn("_f", F.transform("_p", lambda t: hit(t).cast("int")))
    # Each match counts the next width tokens only, so the work grows with the text, not with the square of its matches.
    ahead = lambda i: F.aggregate(F.slice("_f", i + 1, width), F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.filter(F.transform("_f", lambda f, i: F.when(f == 1, F.struct(ahead(i).alias("n"), (-i).alias("p")))), lambda b: b.isNotNull()))
    df = df.withColumn("_b", best).withColumn("_s", F.coalesce(-F.col("_b.p"), F.lit(0)))
    shown = F.zip_with(F.slice("_p", F.col("_s") + 1, width), F.slice("_f", F.col("_s") + 1, width), lambda t, f: F.when(f == 1, F.concat(F.lit("<b>"), t, F.lit("</b>"))).otherwise(t))
    text = F.concat(F.when(F.col("_s") > 0, "...").otherwise(""), F.array_join(shown, " "), F.when(F.size("_p") > F.col("_s") + width, "...").otherwise(""))
    return df.withColumn(out, text).drop("_p", "_f", "_b", "_s")


def _any(w: Column, words: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for word, prefix in words:
        out = out | (w.startswith(word) if prefix else w == word)
    return out
