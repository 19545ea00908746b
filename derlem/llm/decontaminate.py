"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of 13 words (all its words, if it has fewer). A window can only occur in a document that has every
one of its words, so the join needs a prefix of one token of the window's words in order of rarity: the rarest by the corpus's own
counts. Neighbouring windows mostly share their rarest word, so an item keeps a few anchors (a word, its place in the item, and the
word beside it). Document words meet anchors in a join on the word; a match fixes how item and document lie to each other, the
bounds of both ends drop windows that would stick out, and the windows left are compared word by word.

Anchors are joined by broadcast in blocks of items of bounded size; one block is enough for any usual benchmark.

Hits are joined back to rows by hashes of id and whole text: rows that agree in both get the same judgement, any others their own.

Defined cases: null and blank texts have no words and are clean; items without words are left out; items with the same id are one
item in the count of items; the same text under two ids counts for both; a null item_id is left out; rows with a null or a
repeated doc_id are each judged by their own text; empty tables give no hits or no rows; other columns are left out by
``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, durable, lookup_join, table

WIDTH = 13
#: Separators of lower-cased words; with capitals kept out of them, texts can be cut before they are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that the items of one block, and their anchors, may take in a broadcast, by a rough upper estimate.
BLOCK_BYTES = 32 << 20
#: Different words of the benchmark up to which they are broadcast to be counted.
VOCABULARY_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


#: What hits are joined by; the names are unlikely to clash with columns of documents.
KEY = ["_row_hash", "_row_chars"]


def _keys() -> list[Column]:
    return [F.xxhash64("doc_id", F.col("text").cast("string")).alias(KEY[0]), F.coalesce(F.length(F.col("text").cast("string")), F.lit(-1)).alias(KEY[1])]


def _items(benchmark: DataFrame) -> DataFrame:
    return (benchmark.where("item_id is not null")
            .select(F.col("item_id").cast("string").alias("item_id"), words_of(ascii_lower(F.col("text"))).alias("item")).distinct()
            .where(F.size("item") > 0).withColumn("item_no", F.xxhash64("item_id", "item")))


def anchors(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """item_no, word, place, side, check: item and document are compared where word matches place, and check the word beside it.

    Every window has its rarest word among the places; side is 0 if neither neighbour is in all windows that the place stands for."""
    # Words meet in full lower case, which is quick; whether they agree in all but A-Z is seen when windows are compared.
    places = items.select("item_no", F.posexplode("item").alias("place", "w")).select("item_no", "place", F.lower("w").alias("word"))
    vocabulary = durable(places.select("word").distinct(), "vocabulary")
    said = docs.select(F.explode(words_of(F.col("text"))).alias("w")).select(F.lower("w").alias("word"))
    if vocabulary.limit(VOCABULARY_ROWS + 1).count() <= VOCABULARY_ROWS:
        counts = said.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:  # words are counted where they are read, so that no more than the corpus's vocabulary is shuffled
        counts = said.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary.hint("merge"), "word")
    rank = places.join(counts, "word", "left").select("item_no", "place", "word", F.coalesce("n", F.lit(0)).alias("n"))
    windows = items.select("item_no", F.size("item").alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("item") - width))).alias("start"))
    of = windows.join(rank, "item_no").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + width))
    rarest = of.groupBy("item_no", "size", "start").agg(F.min(F.struct("n", "word", "place")).alias("r"))
    by_place = rarest.groupBy("item_no", "size", F.col("r.word").alias("word"), F.col("r.place").alias("place")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    length = F.least(F.lit(width), F.col("size"))
    side = F.when(F.col("first") + length - 1 > F.col("place"), 1).when(F.col("last") < F.col("place"), -1).otherwise(0)
    beside = places.select("item_no", F.col("place").alias("beside"), F.col("word").alias("check"))
    return (by_place.withColumn("side", side).withColumn("beside", F.col("place") + F.col("side")).join(beside, ["item_no", "beside"])
            .select("item_no", "word", "place", "side", "check", F.col("size").alias("item_words")))


def _hits(docs: DataFrame, block: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """KEY, item_id, size, at: places of the document where windows of the item start."""
    words = docs.select(*KEY, words_of(F.col("text")).alias("words"))
    said = words.select(*KEY, "words", F.posexplode("words").alias("p", "w")).withColumn("word", F.lower("w"))
    met = said.join(F.broadcast(block), "word").where(F.lower(F.get("words", F.col("p") + F.col("side"))) == F.col("check"))
    shift = F.col("p") - F.col("place")
    low, high = F.greatest(F.lit(0), shift), F.least(F.size("words"), shift + F.col("item_words"))
    # The words that the item lies on, once for each way to lie: only they are shuffled.
    met = met.select(*KEY, "item_no", shift.alias("shift"), F.slice("words", low + 1, F.greatest(F.lit(0), high - low)).alias("part")).distinct()
    met = met.join(F.broadcast(items), "item_no").withColumn("size", F.least(F.lit(width), F.size("item")))
    met = met.withColumn("part", F.transform("part", ascii_lower)).withColumn("skip", F.greatest(F.lit(0), -F.col("shift")))
    starts = F.when(F.size("part") >= F.col("size"), F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("part") - F.col("size")))).otherwise(F.array().cast("array<int>"))
    same = F.filter(starts, lambda k: F.slice("part", k + 1, F.col("size")) == F.slice("item", F.col("skip") + k + 1, F.col("size")))
    at = F.transform(same, lambda k: k + F.greatest(F.lit(0), F.col("shift")))
    return met.select(*KEY, "item_id", "size", at.alias("at"))


def _covered(at: Column) -> Column:
    """Number of places in a sorted array of (start, size) intervals that overlap."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        at, start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(s["end"], x["start"]))).alias("n"),
            F.greatest(s["end"], x["start"] + x["size"]).alias("end")),
        lambda s: s["n"])


def _found(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> DataFrame | None:
    """KEY, n_hit, items of the documents with hits; None if the benchmark has no words. docs has KEY."""
    items = durable(_items(benchmark), "items")
    known = durable(anchors(docs, items, width), "anchors")
    size = items.agg(F.sum(F.octet_length(F.array_join("item", " ")) * 8 + 64)).first()[0] or 0
    blocks = -(-size // block_bytes)
    hits = None
    for k in range(blocks):
        own = F.pmod("item_no", F.lit(blocks)) == k
        found = _hits(docs, known.where(own), items.where(own), width)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return None
    spans = hits.select(*KEY, "item_id", F.explode("at").alias("start"), "size").groupBy(*KEY).agg(
        _covered(F.array_sort(F.collect_set(F.struct("start", "size")))).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return durable(spans, "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, n_hit, items (sorted array of the ids found)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), *_keys())
    found = _found(docs, benchmark, width, block_bytes)
    counts = docs.select("doc_id", *KEY, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if found is None:
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    return lookup_join(counts, found, KEY).select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go; the others keep all columns."""
    found = _found(docs.select("doc_id", F.col("text").cast("string").alias("text"), *_keys()), benchmark, WIDTH, BLOCK_BYTES)
    if found is None:
        return docs
    rows = docs.select(F.struct("*").alias("_doc"), *_keys())  # as a struct, no column clashes
    words = F.when(F.col("_n_hit") > 0, F.size(words_of(F.col("_doc.text").cast("string"))))  # of the few documents with hits only
    rows = lookup_join(rows, found.select(*KEY, F.col("n_hit").alias("_n_hit")), KEY)
    return rows.where(~F.coalesce(is_contaminated(F.col("_n_hit"), words), F.lit(False))).select("_doc.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
