"""Audit of how far the sources of a language differ in their words, by an inverted index with corrections of a baseline.

A group is the documents of one language and source. A language keeps the terms that enough of its documents have, V of them; a group gives
each kept term the smoothed share p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), N its kept terms' occurrences, and two shares differ by
f = floor((p - q)**2 / (p + q)). Two groups differ by the sum of f over all kept terms. Most terms of two groups have count 0 in both, so
a pair starts at V times the f of two zero counts, and the postings of a term (the groups that have it) only add what differs from that:

- one side: f(p, zero of the other) - f(zeros), for each posting and each other group. Counts repeat (most are 1, 2, 3), so a group's
  postings are first counted by their share: a row for each different count, not for each term;
- both sides: f(p, q) - f(p, zero) - f(zero, q) + f(zeros), for the pairs of postings of a term; those that are nonzero are summed by pair
  in the task that makes them.

So no table of all groups and terms is ever made. Terms are counted where the texts are read, some texts at a time, and a task sums them
by group before they are shuffled: a source that a third of all rows have sends as many rows as any other. A pair of groups is a row of the result, and no more is emitted for
a term than pairs of its groups. Terms over their language's share are ranked by a window whose first ranks are taken in each task before
the shuffle. Shares are computed in decimals and longs, without rounding.

Defined cases: null text, lang and source are empty strings; a group without terms has count 0 everywhere; a language without kept terms has
differences of 0 and no terms; a source alone in its language has no pairs; repeated rows and null doc_ids are documents like any other;
empty tables give an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, durable, lookup_join, table

LEAST_DOCUMENTS, TERM_RANKS, UNIT, PRIOR = 10, 10, 1_000_000_000, 2
#: Bytes of text that are counted at a time; a longer text is counted alone.
HELD = 32 << 20
#: By byte: what A-Z are lower-cased to, and whether it belongs to a term, as ASCII letters do and all bytes beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[np.frombuffer(UPPER.encode(), dtype=np.uint8)] = np.frombuffer(LOWER.encode(), dtype=np.uint8)
_TERM = np.arange(256) >= 128
_TERM[np.frombuffer((UPPER + LOWER).encode(), dtype=np.uint8)] = True


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the terms of all texts, in order; the number of the text that each is in)."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[ends[:-1][ends[:-1] < len(data)]] = inside[ends[:-1][ends[:-1] < len(data)]]  # terms end with their text
    starts = np.flatnonzero(begins)
    # Without what is between them, the terms' bytes are the data of an array, and where they begin are its offsets.
    letters = np.cumsum(inside, dtype=np.int64)
    offsets = np.append(letters[starts] - 1, letters[-1] if len(letters) else 0)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    return found, np.searchsorted(ends, starts, side="right") - 1


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """texts, languages and sources -> a row for each term of each group, and one without a term for each group."""
    langs, sources = (batch.column(i).dictionary_encode() for i in (1, 2))
    group, row_group = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
    found, text = terms(batch.column(0))
    found = found.dictionary_encode()
    many = max(1, len(found.dictionary))
    # First the terms of each text, then of each group.
    each, times = np.unique(text * many + found.indices.to_numpy(), return_counts=True)
    key = row_group[each // many] * many + each % many
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    n = np.add.reduceat(times, first) if len(first) else first
    g, term = key[first] // many, key[first] % many
    own = np.arange(len(group))
    of = np.concatenate((g, own))
    words = pa.concat_arrays([found.dictionary.take(pa.array(term)).cast(pa.binary()).cast(pa.string()), pa.nulls(len(own), pa.string())])
    none = np.zeros(len(own), dtype=np.int64)
    columns = [langs.dictionary.take(pa.array(group[of] // len(sources.dictionary))), sources.dictionary.take(pa.array(group[of] % len(sources.dictionary))), words,
               pa.array(np.concatenate((n, none))), pa.array(np.concatenate((np.diff(np.append(first, len(key))), none)))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """docs(text, lang, source) -> lang, source, term, n, docs: of some texts at a time; a null term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(size):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + held, side="right")))
                yield _counted(batch.slice(at, end - at))
                at = end

    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*filled).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, n: Column, v: Column) -> Column:
    """The smoothed share of a term; its product passes a long at ten billion occurrences, so it is a decimal."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = (whole(count) + PRIOR).cast("decimal(21,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = whole(n) + F.lit(2).cast("decimal(2,0)") * whole(v)
    # Div on decimals is whole division.
    return F.call_function("div", above, below).cast("long") + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS, held: int = HELD) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part, item, value, rank."""
    counted = durable(term_counts(docs, held).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    words = counted.where("term is not null")
    kept = durable(words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_documents).select("lang", "term", "lang_n"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("all_n"))
    postings = durable(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "postings")
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "all_n", "total")])
    groups = durable(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))), "groups")
    shares = lookup_join(postings, groups, ["lang", "source"], "inner")
    shares = shares.select("lang", "source", "term", "n", "zero", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("all_n"), F.col("v")).alias("q"))
    shares = durable(shares, "shares")
    return pairs(groups, shares).unionByName(top_terms(shares, term_ranks))


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Every two groups of a language, both ways: V times the zeros' difference and the corrections of terms that one or both have."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero2"))
    zeros = difference(F.col("zero"), F.col("zero2"))
    # The result has a row for each of these anyway.
    start = groups.select("lang", "source", "zero", "v").join(others, "lang").where("source <> item")
    start = start.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * zeros).otherwise(F.lit(0)).alias("value"))

    equal = shares.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("terms"))
    one = equal.join(others, "lang").where("source <> item").withColumn("value", F.col("terms") * (difference(F.col("p"), F.col("zero2")) - zeros)).where("value <> 0")
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one = one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    second = shares.select("lang", "term", F.col("source").alias("item"), F.col("zero").alias("zero2"), F.col("p").alias("p2"))
    both = shares.select("lang", "term", "source", "zero", "p").join(second.hint("merge"), ["lang", "term"]).where("source < item")
    value = difference(F.col("p"), F.col("p2")) - difference(F.col("p"), F.col("zero2")) - difference(F.col("zero"), F.col("p2")) + zeros
    both = both.select("lang", "source", "item", value.alias("value")).where("value <> 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    total = start.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(total.withColumn("part", F.lit("pair")))


def top_terms(shares: DataFrame, ranks: int) -> DataFrame:
    """The terms that a group uses more than its language, by how much."""
    rows = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).where(F.col("rank") <= ranks)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
