"""Quality rules: fixed counts of a text, and how far its character classes and common words lie from those of its language.

For each language, the counts of all its documents add up to two reference histograms: character classes, and common words against
all others. A document's own histograms are compared with them by the Jensen-Shannon distance (the root of the divergence, base 2). Texts
too short for a histogram to mean much aren't judged by it. All of it is DataFrame functions: texts are read once into a narrow table
of counts, the references are sums of it, one row for each language.

Defined cases: null and blank texts have no words and fail the base rule; a null language is a language of its own; a language whose
texts are all empty has an empty reference, which judges nothing; repeated and null doc_ids each give a row; an empty table gives an
empty one; other columns are left out by ``judge`` and kept by nobody: join on the id for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, durable, lookup_join, table

#: Character classes; what none of them has is the last class.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", WORD_GAP[:-1], r"[.,;:!?'\x22()-]", r"[^\x00-\x7F]")
SYMBOLS = r"[#*$%&|<>]"
#: Very common words of English, French, German and Spanish.
COMMON_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "le", "et", "les", "des", "en", "un", "der", "die", "und", "den", "von", "zu", "das", "mit", "que", "el", "y", "los", "del", "se", "para", "con")


@dataclass(frozen=True)
class Rules:
    """least_words: texts of fewer fail. repeat_percent: words in repeated windows beyond this share fail.
    char_guard, word_guard: characters and words from which the histograms are judged. char_limit, word_limit: greatest distances kept."""

    least_words: int = 10
    window: int = 5
    repeat_percent: int = 20
    char_guard: int = 200
    word_guard: int = 50
    char_limit: float = 0.28
    word_limit: float = 0.45


def _repeat_words(rows: DataFrame, window: int) -> DataFrame:
    """n_repeat_words from words: hashes of windows are sorted with their places; equal neighbours are repeats; their spans are added up."""
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("hash", hashes).drop("words")
    # The array is used twice below, so that it is made once.
    starts = F.when(F.size("hash") >= window, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("hash") - (window - 1)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("hash", i, window)))).drop("hash")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("pairs", pairs).drop("windows")
    beside = lambda k: F.get("pairs", k)["h"]
    marked = F.transform("pairs", lambda p, k: F.when((beside(k - 1) == p["h"]) | (beside(k + 1) == p["h"]), p["i"]))
    places = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + window - F.greatest(s["end"], i)).alias("n"), (i + window).alias("end")),
        lambda s: s["n"].cast("long"))
    return rows.withColumn("n_repeat_words", covered).drop("pairs")


def counts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, lang, the counts of the base rule, and both histograms."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    classes = [F.regexp_count("text", F.lit(c)).cast("long") for c in CLASSES]
    rows = rows.select(
        "doc_id", "lang", "words", F.length("text").cast("long").alias("n_chars"), F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.array(*classes).alias("classes"),
        F.filter("words", lambda w: w.isin(*COMMON_WORDS)).alias("common"))
    each = F.transform(F.array(*map(F.lit, COMMON_WORDS)), lambda r: F.size(F.filter("common", lambda c: c == r)).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("classes", F.concat("classes", F.array(F.col("n_chars") - total("classes"))))
    rows = rows.withColumn("common", F.concat(each, F.array(F.col("n_words") - F.size("common"))))
    return _repeat_words(rows, rules.window)


def references(counted: DataFrame) -> DataFrame:
    """lang, ref_classes, ref_common: sums over all texts of a language."""
    sums = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c, n in (("classes", len(CLASSES) + 1), ("common", len(COMMON_WORDS) + 1)) for k in range(n)]
    out = counted.groupBy("lang").agg(*sums)
    return out.select("lang", *[F.array(*[F.col(f"{c}{k}") for k in range(n)]).alias(f"ref_{c}") for c, n in (("classes", len(CLASSES) + 1), ("common", len(COMMON_WORDS) + 1))])


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if one is all zero."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    share = lambda x: F.transform(x, lambda v: v / total(x))
    terms = F.zip_with(share(a), share(b), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    jsd = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2))
    return F.when((total(a) > 0) & (total(b) > 0), jsd)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, the base counts, base_failed, char_distance, word_distance, kept."""
    counted = durable(counts(docs, rules), "counts")
    refs = durable(references(counted), "references")
    rows = lookup_join(counted, refs, "lang")
    rows = rows.withColumn("char_distance", distance(F.col("classes"), F.col("ref_classes"))).withColumn("word_distance", distance(F.col("common"), F.col("ref_common")))
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    far = ((F.col("n_chars") >= rules.char_guard) & (F.coalesce("char_distance", F.lit(0.0)) > rules.char_limit)) | ((F.col("n_words") >= rules.word_guard) & (F.coalesce("word_distance", F.lit(0.0)) > rules.word_limit))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_distance", "word_distance")


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")
