"""Near duplicates by SimHash: all documents whose 64-bit fingerprints differ in at most three bits, and the groups they form.

Search by meeting in the middle. The 64 bits are cut into three blocks. If two fingerprints differ in at most three bits, they
differ in at most two outside the block that differs most; so for each block left out, every distinct fingerprint emits its
remaining bits and all variants of them within half of that radius, one bit (1 + 43 variants), and two such fingerprints share a
variant. Rows are shuffled on variants; a pair is taken at one agreed meeting point only, and only if the whole
fingerprints are within the radius, so that the join gives each link once. Copies share a fingerprint and are one row here.

Where many distinct fingerprints crowd around one key (more than ``crowd``), pairs could grow with the square of the crowd. Those
fingerprints take another exact way: they emit the whole ball of two bits (2,081 variants). All within one bit of a variant
lie within two bits of each other, and within three of those two bits off; so each variant links all its fingerprints to its
least near one, which keeps every component, with rows in proportion to the fingerprints.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a null doc_id never names a
component (null if there is no other); repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lookup_join, table
from .components import components

RADIUS = 3
#: Bit ranges (from, to) of the three blocks.
BLOCKS = ((0, 22), (22, 43), (43, 64))
CROWD = 512


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_KEEP = [((1 << 64) - 1) ^ ((1 << b) - (1 << a)) for a, b in BLOCKS]
#: (block left out, bits to flip) of all variants.
_VARIANTS = [(i, flip) for i, keep in enumerate(_KEEP) for flip in [0, *(1 << k for k in range(64) if keep >> k & 1)]]
_BALL = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash over shingles of width words: a bit is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 65536):
        count += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(rows)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (signed long); texts stay where they are read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _key(fp: Column, block: Column) -> Column:
    keep = F.when(block == 0, F.lit(_signed(_KEEP[0]))).when(block == 1, F.lit(_signed(_KEEP[1]))).otherwise(F.lit(_signed(_KEEP[2])))
    return fp.bitwiseAND(keep)


def _variants(prints: DataFrame) -> DataFrame:
    emitted = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(_signed(flip)).alias("flip")) for b, flip in _VARIANTS]))
    rows = prints.select("fp", emitted.alias("e"))
    return rows.select("fp", F.col("e.block").alias("block"), _key(F.col("fp"), F.col("e.block")).bitwiseXOR(F.col("e.flip")).alias("v"))


def _meet(rows: DataFrame, radius: int) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    block = F.col("a.block")
    outside = _key(diff, block)
    # Two bits apart, the keys meet at two variants: the one with the lowest differing bit of a flipped is agreed on.
    low = F.when(F.bit_count(outside) == 2, outside.bitwiseAND(-outside)).otherwise(F.lit(0))
    first = ((block == 0) | (F.bit_count(_key(diff, F.lit(0))) > 2)) & ((block < 2) | (F.bit_count(_key(diff, F.lit(1))) > 2))
    at = (F.col("a.v") == _key(F.col("a.fp"), block).bitwiseXOR(low)) & first
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(diff) <= radius) & at
    return a.join(b.hint("merge"), on).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _ball_links(prints: DataFrame, radius: int) -> DataFrame:
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in _BALL]))
    rows = prints.select("fp", masks.alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"), (F.bit_count("m") <= 1).alias("near"))
    hubs = rows.groupBy("v").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1").select("v", "hub")
    return rows.join(hubs, "v").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def links(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """prints(fp), distinct -> (u, v): links that give the components of all fingerprints within the radius; all of them, but among crowds."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}")
    rows = _variants(prints)
    crowds = durable(
        prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("block")).select("block", _key(F.col("fp"), F.col("block")).alias("key"))
        .groupBy("block", "key").count().where(F.col("count") > crowd).select("block", "key"), "crowds")
    if not crowds.limit(1).count():
        return _meet(rows, radius)
    if radius < RADIUS:
        raise ValueError("crowds are linked by hubs, which needs the full radius")
    emitted = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(_signed(flip)).alias("flip")) for b, flip in _VARIANTS])).alias("e")
    near = crowds.select("block", "key", emitted).where("e.b = block").select("block", F.col("key").bitwiseXOR(F.col("e.flip")).alias("v")).distinct()
    hot = durable(rows.join(near, ["block", "v"], "left_semi").select("fp").distinct(), "crowded")
    return _meet(rows.join(near, ["block", "v"], "left_anti"), radius).unionByName(_ball_links(hot, radius))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id: the least doc_id that links reach, the document's own included."""
    prints = durable(fingerprints(docs), "fingerprints")
    groups = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    of = components(links(groups.select("fp"), radius, crowd)).withColumnRenamed("node", "fp")
    linked = durable(groups.join(of, "fp"), "linked")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = linked.join(roots, "root").select("fp", "component_id").unionByName(
        groups.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id")))
    return lookup_join(prints, durable(lookup, "component"), "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def _prints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))


def _with_row_keys(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with two more columns that name each row, the same at every reading: where it is stored, or a number in a copy that is written here."""
    try:
        return docs.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    except AnalysisException:  # not read from files
        return durable(docs.withColumns({file: F.lit(""), row: F.monotonically_increasing_id()}), "rows")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """One row of each group stays, with all its columns.

    Rows are judged, not ids: a row goes if its own text is in a group of which another row stays, which is the one with the least doc_id, null
    ids last, and of equal ids the first as written. So rows that share an id but not a text are apart, repeated rows leave one, and rows
    without an id are rows like any other."""
    names = [[c for c in (f"_{name}{i or ''}" for i in range(len(docs.columns) + 1)) if c not in docs.columns][0] for name in ("file", "row")]
    rows = _with_row_keys(docs, *names)
    key = [F.col(names[0]).alias("file"), F.col(names[1]).alias("row")]
    prints = durable(rows.select("doc_id", *key, F.arrow_udf(_prints, "long")(F.col("text").cast("string")).alias("fp")), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    groups = durable(prints.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "groups")
    of = components(links(groups.select("fp"), radius, crowd)).withColumnRenamed("node", "fp")
    linked = durable(groups.join(of, "fp"), "linked")
    firsts = linked.join(linked.groupBy("root").agg(F.min("first").alias("stays")), "root").select("fp", "stays")
    alone = groups.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("stays"))
    found = lookup_join(prints, durable(firsts.unionByName(alone), "stays"), "fp", "inner")
    gone = found.where((F.col("file") != F.col("stays.file")) | (F.col("row") != F.col("stays.row"))).select(*[F.col(c).alias(n) for c, n in zip(("file", "row"), names, strict=True)])
    return lookup_join(rows, durable(gone, "copies"), names, "left_anti").select(*docs.columns)


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
