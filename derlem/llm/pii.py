"""Personal data: fixed formats, and what a bootstrapped search of contexts finds beyond them.

Seeds are matches of four fixed formats (email, ip, card, phone). The words beside seeds (one or two to the left, one to the right)
are lexical patterns. Unknown tokens that look like identifiers are candidates; patterns and instances (seeds and candidates) form
a graph whose scores Spark updates in rounds: a pattern is as good as the share of known instances among those it has, an instance is as
good as its good patterns together (noisy or). A pattern counts only if it has enough known instances and if identifiers are a
fair share of all places of the corpus where its words stand, so that common words don't become patterns. Candidates of a high score
are found wherever they occur, under the kind that their patterns share.

Texts are scanned in place. Only rows about matches are shuffled, edges are distinct before they are scored, so copies of a text
add nothing, and scores are sums over edges: no group is gathered.

Defined cases: null and empty texts have no spans; a null doc_id, repeated ids and repeated rows each give a row; empty tables give
empty ones; matches of different kinds may overlap and are all reported; offsets are code points; other columns are left out by
``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lookup_join, table

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; known instances that a pattern needs; its least share of known ones; identifiers' least share of its
    places; the least score of an instance that is reported; characters to each side within which words are beside a token: a word that
    isn't whole within them isn't."""

    rounds: int = 3
    support: int = 5
    precision: float = 0.7
    share: float = 0.2
    accept: float = 0.8
    reach: int = 120


_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits are matched as whole runs: a start inside a run fails where its beginning did, and this keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
#: Tokens with three digits or more, of five characters or more: what may be an identifier.
_CANDIDATE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._/+-]*[A-Za-z0-9])?")
_WORD = re.compile(r"\w+")


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @ outwards, which gives the leftmost matches of the format in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all matches, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens around digits that look like identifiers and touch no base span."""
    out, done, k = [], 0, 0
    ends = sorted((b, a) for a, _, b in taken)
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._/+-")):
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        token = _CANDIDATE.match(text, start)
        end = token.end() if token else m.end()
        done = max(end, m.end())
        while k < len(ends) and ends[k][0] <= start:
            k += 1
        if end - start >= 5 and sum(c.isdigit() for c in text[start:end]) >= 3 and not any(a < end for b, a in ends[k:] if b > start):
            out.append((start, end))
    return out


def _context(text: str, start: int, end: int, reach: int) -> tuple[str, str, str]:
    begin, stop = max(0, start - reach), end + reach
    left = _WORD.findall(text, begin, start)
    if begin and 0 < len(left) < 3:
        across = _WORD.match(text, begin - 1, start)
        left = left[1:] if across and across.end() > begin else left
    left = left[-2:]
    m = _WORD.search(text, end, stop)
    right = m[0] if m and not (m.end() == stop and _WORD.match(text, stop)) else ""
    return left[-1] if left else "", " ".join(left) if len(left) == 2 else "", right


_FOUND = "array<struct<kind: int, start: long, end: long, value: long, l1: string, l2: string, r1: string>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("l1", pa.string()), ("l2", pa.string()), ("r1", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for value in batch.column(2):
            text = value.as_py() or ""
            base = base_spans(text)
            spans = [(k, a, b) for a, k, b in base] + [(-1, a, b) for a, b in candidates(text, base)]
            row = []
            for k, a, b in spans:
                l1, l2, r1 = _context(text, a, b, reach)
                value = int.from_bytes(hashlib.blake2b(text[a:b].lower().encode(), digest_size=8).digest(), "little", signed=True)
                row.append({"kind": k, "start": a, "end": b, "value": value, "l1": l1, "l2": l2, "r1": r1})
            found.append(row)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _FOUND_TYPE)], names=["doc_id", "text_key", "found"])


def scan(docs: DataFrame, reach: int = Bootstrap.reach) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_key, found: base matches (kind 0 to 3) and candidates (kind -1) with the words beside them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scan(batches, reach), f"doc_id long, text_key long, found {_FOUND}")


def _edges(found: DataFrame) -> DataFrame:
    """pattern, value, kind: one row each."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.lower(F.col(f"f.{side}")).alias("words")) for side in ("l1", "l2", "r1")])
    rows = found.select(F.explode("found").alias("f")).select("f.kind", "f.value", F.explode(sides).alias("s")).where("s.words <> ''")
    return rows.select(F.col("s.side").alias("side"), F.col("s.words").alias("words"), "value", "kind")


def _places(docs: DataFrame, words: DataFrame) -> DataFrame:
    """How often each of some contexts (one word, or two in a row) stands in the corpus."""
    said = docs.select(F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), "").alias("w"))
    said = said.select("w", F.posexplode("w").alias("p", "word"))
    said = said.select(F.explode(F.array("word", F.concat_ws(" ", F.get("w", F.col("p") - 1), "word"))).alias("words"))
    return lookup_join(said, words, "words", "inner").groupBy("words").agg(F.count("*").alias("places"))


def discover(docs: DataFrame, found: DataFrame, at: Bootstrap = Bootstrap()) -> DataFrame:
    """value, kind of the candidates that patterns reveal; found is durable."""
    rows = _edges(found)
    # A pattern needs a score of at.support from values that count 1 at most, whether seeds or accepted in an earlier round: contexts of fewer
    # values can't get it in any round, and contexts without candidates discover nothing. All others stay in the graph for all rounds.
    size = rows.groupBy("side", "words").agg(F.countDistinct("value").alias("n"), F.min("kind").alias("least"))
    lively = durable(size.where((F.col("n") >= at.support) & (F.col("least") < 0)).select("side", "words"), "contexts")
    edges = lookup_join(rows, lively, ["side", "words"], "inner")
    places = _places(docs, durable(lively.select("words").distinct(), "context_words"))
    used = edges.groupBy("side", "words").agg(F.count("*").alias("used")).join(places, "words", "left")
    fair = durable(used.where(F.col("used") >= at.share * F.col("places")).select("side", "words"), "patterns")
    edges = durable(lookup_join(edges, fair, ["side", "words"], "inner").groupBy("side", "words", "value").agg(F.max("kind").alias("kind")), "edges")
    size = edges.groupBy("side", "words").agg(F.count("*").alias("n"))
    score = edges.where("kind >= 0").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    seeds, unknown = score, edges.where("kind < 0").select("side", "words", "value")
    for _ in range(at.rounds):
        sums = edges.select("side", "words", "value").join(score, "value").groupBy("side", "words", "kind").agg(F.sum("score").alias("good"))
        pattern = sums.join(size, ["side", "words"]).withColumn("trust", F.col("good") / (F.col("n") + 1))
        pattern = pattern.where((F.col("good") >= at.support) & (F.col("trust") >= at.precision))
        gained = unknown.join(pattern, ["side", "words"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        score = durable(seeds.unionByName(gained).groupBy("value", "kind").agg(F.max("score").alias("score")), "scores")  # a seed that is a candidate elsewhere counts once
    best = score.join(unknown.select("value").distinct(), "value", "left_semi").where(F.col("score") >= at.accept)
    return best.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("value", (-F.col("b.k")).cast("int").alias("kind"))


def _with_discovered(docs: DataFrame, at: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """All rows of the scan, and the spans that were discovered: row, start, end, kind."""
    found = durable(scan(docs, at.reach).withColumn("row", F.monotonically_increasing_id()), "pii")
    values = durable(discover(docs, found, at), "discovered").withColumnRenamed("kind", "as_kind")
    loose = found.select("row", F.explode(F.filter("found", lambda f: f["kind"] < 0)).alias("f")).select("row", "f.start", "f.end", "f.value")
    return found, lookup_join(loose, values, "value", "inner").select("row", F.col("as_kind").alias("kind"), "start", "end")


def find(docs: DataFrame, at: Bootstrap = Bootstrap()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_key, base and spans: arrays of (start, kind, end) in order; spans has the discovered ones too."""
    found, more = _with_discovered(docs, at)
    span = lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end"))
    extra = durable(more.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra")), "extra")
    rows = lookup_join(found, extra, "row")
    base = F.array_sort(F.transform(F.filter("found", lambda f: f["kind"] >= 0), span))
    rows = rows.select("doc_id", "text_key", base.alias("base"), "extra")
    return rows.select("doc_id", "text_key", "base", F.array_sort(F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra"))).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, at: Bootstrap = Bootstrap()) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, spans that overlap by that of the first; n_chars follows the text."""
    names = docs.columns
    keys = ["_pii_null", "_pii_id", "_pii_key"]  # a null id is told apart, and its rows by their texts
    key = lambda doc_id, text_key: [doc_id.isNull().alias(keys[0]), F.coalesce(doc_id.cast("long"), F.lit(-1)).alias(keys[1]), text_key.alias(keys[2])]
    spans = find(docs.select("doc_id", "text"), at).where(F.size("spans") > 0)
    spans = durable(spans.select(*key(F.col("doc_id"), F.col("text_key")), F.col("spans").alias("_pii_spans")).dropDuplicates(keys), "spans")
    joined = lookup_join(docs.select("*", *key(F.col("doc_id"), F.xxhash64("text"))), spans, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, found in enumerate(batch.column("_pii_spans").to_pylist()):
                if found:
                    out, done = [], 0
                    for s in found:
                        if s["start"] >= done:
                            out += [texts[i][done : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                        done = max(done, s["end"])
                    texts[i] = "".join([*out, texts[i][done:]])
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    done = joined.select(*names, "_pii_spans").mapInArrow(run, docs.schema)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
