import random

import xxhash
from pyspark.sql import functions as F

from derlem.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(prints, radius=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    return {p: find(p) for p in prints}


def cloud(seed, n):
    r = random.Random(seed)
    out = set()
    for _ in range(n):
        centre = r.getrandbits(64)
        out.add(centre)
        for _ in range(12):
            x = centre
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)


def same_groups(spark, prints, crowd):
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(simhash.links(df, 3, crowd)).collect()}
    want = groups_by_force(prints)
    size = {}
    for p in prints:
        size.setdefault(want[p], set()).add(p)
    for members in size.values():
        if len(members) == 1:
            assert not members & got.keys()
        else:
            assert len({got[m] for m in members}) == 1
    assert len(set(got.values())) == sum(len(m) > 1 for m in size.values())


def test_links_against_all_pairs(spark):
    same_groups(spark, cloud(1, 30), 512)


def test_crowds_take_the_ball(spark):
    same_groups(spark, cloud(2, 25), 2)


def test_links_are_exact_pairs(spark):
    prints = cloud(3, 20)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = sorted(tuple(sorted((r.u & (2**64 - 1), r.v & (2**64 - 1)))) for r in simhash.links(df).collect())
    assert got == sorted((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3)


def test_query_against_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {d.doc_id: slow_fingerprint(d.text) for d in docs}
    root = groups_by_force(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash_groups(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, None), (2, ""), (2, " \n"), (5, "A b  c\td"), (4, "ﬂ  x"), (9, "x " * 50000)], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 5), (1, 1), (2, 1), (2, 1), (4, 4), (5, 5), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in simhash.drop_near_duplicates(docs).collect()) == [1, 4, 5, 9]  # the row without an id is a copy of 5


def test_stage_judges_rows_not_ids(spark, tmp_path):
    """A text of its own stays whatever id it has, and of copies one row stays whatever ids they have."""
    one, other, third = ("the quick brown fox jumps over the lazy dog near a river bank", "something else entirely with words of its own and no copy anywhere", "a third text that only rows without any id have in this small table")
    rows = [(1, one, "a"), (1, one, "a"), (5, one, "b"), (5, other, "c"), (None, one, "d"), (None, one, "d"), (None, third, "e"), (None, third, "f"), (7, "", "g"), (3, None, "h")]
    docs = spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in rows], "doc_id long, text string, source string, _row int, fp int").repartition(4)
    docs.write.parquet(str(tmp_path / "docs"))
    for docs in (docs, spark.read.parquet(str(tmp_path / "docs"))):  # rows are told apart by a number, and by where they are stored
        out = simhash.drop_near_duplicates(docs)
        assert out.schema == docs.schema
        got = sorted((r.doc_id or -1, r.text) for r in out.collect() if r.text)
        assert got == sorted([(1, one), (5, other), (-1, third)])
        assert [r.doc_id for r in out.collect() if not r.text] == [3]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    same = simhash.drop_near_duplicates(docs.where("source in ('a', 'd')")).collect()
    assert [(r.doc_id, r.source) for r in same] == [(1, "a")]
