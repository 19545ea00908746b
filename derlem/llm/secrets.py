"""Secret scan with corpus-wide ownership.

Fixed formats (assignments, access keys, long hex runs) are always reported. Beyond them, long tokens that mix letters and digits are
candidates; by themselves they say little. Each candidate's hash is counted by distinct owners and distinct repositories over the whole
corpus: what many owners or repositories have is a widely copied example, what one owner has in few repositories looks live. Base
matches get the same verdict.

Texts are searched by SQL functions alone. A search splits a text at its matches: the lengths of the pieces give the offsets. Counts go
in two steps, distinct (hash, owner, repository) first, so a hash that a third of all rows have is a few rows by then.

Defined cases: null and empty texts have no spans; null owners and repositories count as one unnamed one; repeated rows, null and
repeated doc_ids each give a row; empty tables give empty ones; matches of different kinds may overlap and are all reported; offsets are
code points; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bind, sums_before
from .common import durable, lookup_join, table

KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than asked fail as wholes, so asking for the length in the pattern finds the same ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9_+/-]{20,}"


@dataclass(frozen=True)
class Ownership:
    """A secret is live-looking if it has at most so many owners and repositories."""

    owners: int = 1
    repositories: int = 3


def _search(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's matches, by splitting the text at them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    gaps = F.transform(F.slice(F.split(text, pattern), 1, F.size(found)), lambda g: F.length(g).cast("long"))

    def placed(b: Column) -> Column:
        # A match starts after all gaps and matches before it, and its own gap.
        before = sums_before(F.zip_with(b["gaps"], b["found"], lambda g, m: g + F.length(m)))
        start = lambda b, s: F.zip_with(s, b["gaps"], lambda x, g: x + g)
        row = lambda a, m: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(m)).alias("end"), m.alias("value"))
        return F.zip_with(start(b, before), b["found"], row)

    folded = bind(F.struct(gaps.alias("gaps"), found.alias("found")), placed)
    return F.when(text.rlike(pattern), folded).otherwise(none)


def scan(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """docs(doc_id, text, owner, repository) -> doc_id, owner, repository, found: all matches and candidates."""
    rows = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assigned = F.filter(_search(F.col("text"), ASSIGN, 0), lambda f: F.length(F.regexp_extract(f["value"], ASSIGN, 1)) >= 6)
    mixed = F.filter(_search(F.col("text"), TOKEN, 3), lambda f: f["value"].rlike("[0-9]") & f["value"].rlike("[a-z]") & f["value"].rlike("[A-Z]"))
    found = F.concat(assigned, _search(F.col("text"), ACCESS, 1), _search(F.col("text"), HEX, 2), mixed)
    hashed = F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end"), F.xxhash64(_value(f), f["kind"]).alias("hash")))
    return rows.select("doc_id", "owner", "repository", found.alias("found")).select("doc_id", "owner", "repository", hashed.alias("found"))


def _value(f: Column) -> Column:
    """What is secret of a match: of an assignment, what is assigned."""
    return F.when(f["kind"] == 0, F.regexp_extract(f["value"], ASSIGN, 1)).otherwise(f["value"])


def ownership(found: DataFrame, at: Ownership = Ownership()) -> DataFrame:
    """hash, owners, repositories, live."""
    one = found.select("owner", "repository", F.explode("found.hash").alias("hash")).distinct()
    counts = one.groupBy("hash").agg(F.countDistinct(F.coalesce("owner", F.lit("")), F.col("owner").isNull()).alias("owners"), F.count("*").alias("repositories"))
    return counts.withColumn("live", (F.col("owners") <= at.owners) & (F.col("repositories") <= at.repositories))


def find_secrets(docs: DataFrame, owner: str, repository: str, at: Ownership = Ownership()) -> DataFrame:
    """doc_id, base (array of start, kind, end), spans (base and live-looking candidates), n_live (of all matches), and the most owners
    and repositories that one of its matches has in the corpus (0 without matches)."""
    found = durable(scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secrets")
    counts = durable(ownership(found, at), "ownership")
    each = lookup_join(found.select("row", F.explode("found").alias("f")).select("row", "f.*"), counts, "hash", "inner")
    # A row's matches are few beside its text; null for those that aren't live, which collect_set leaves out.
    own = each.groupBy("row").agg(
        F.collect_set(F.when(F.col("live"), F.struct("start", "kind", "end"))).alias("own"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    rows = lookup_join(found, durable(own, "own"), "row")
    base = F.array_sort(F.transform(F.filter("found", lambda f: f["kind"] < 3), lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end"))))
    own = F.coalesce("own", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    # A candidate that a base match covers in part or whole tells nothing new.
    new = F.filter("own", lambda c: (c["kind"] == 3) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    most = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("most_owners", "most_repositories")]
    rows = rows.select("doc_id", base.alias("base"), own.alias("own"), *most)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", new)).alias("spans"), F.size("own").cast("long").alias("n_live"), "most_owners", "most_repositories")


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the sources of documents; a source's documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents").withColumn("repository", F.concat_ws("/", "source", "lang"))
    found = find_secrets(docs, "source", "repository")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), "n_live", "most_owners", "most_repositories")
