import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from derlem.llm import bin_completion as b
from derlem.llm import packing as p
from derlem.llm.tokens import encoder

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def exact(items, capacity):
    """Fewest bins by trying all placements."""
    items, best = sorted(items, reverse=True), len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= items[k] and rooms[i] not in rooms[:i]:
                go(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def used(packing, capacity):
    out = Counter()
    for filling, times in packing:
        assert sum(filling) <= capacity
        for x in filling:
            out[x] += times
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_small_packings_are_optimal(items):
    counts = dict(Counter(items))
    got = b.pack(counts, 30)
    assert used(got, 30) == Counter(items)
    assert sum(t for _, t in got) == exact(items, 30)
    assert b.lower_bound(counts, 30) <= exact(items, 30)


@pytest.mark.parametrize("seed", range(3))
def test_large_packings_come_near_the_bound(seed):
    r = random.Random(seed)
    counts = dict(Counter(min(2048, max(1, int(r.lognormvariate(6, 1.2)))) for _ in range(20000)))
    got = b.pack(counts, 2048, nodes=3000)
    assert used(got, 2048) == Counter(counts)
    assert sum(t for _, t in got) <= sum(t for _, t in b.best_fit_decreasing(counts, 2048))
    assert sum(t for _, t in got) <= 1.002 * b.lower_bound(counts, 2048) + 1


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_equal_those_of_the_json_vocabulary(text):
    assert np.frombuffer(encoder()(text), dtype="<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a", "  a   b\n\n c\t\t", "it's we'LL 12345 ½ é  x", "a" * 5000, " " * 3000])
def test_ids_of_odd_texts(text):
    assert np.frombuffer(encoder()(text), dtype="<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


def check(rows, docs, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in docs:
        ids = np.array([*HF.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(by_sequence), -(-total // capacity)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, bound = check(p.op5_best_fit_packing(spark, sf).collect(), docs, 2048)
    assert n <= bound + 2


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b " * 2000), (4, "word"), (5, "word"), *((i, "x " * (i % 7)) for i in range(10, 300))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("offset", F.lit(1))
    check(p.pack_documents(df.repartition(7), capacity=64).collect(), docs, 64)
    with_null = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b")], "doc_id long, text string")
    rows = p.pack_documents(with_null, with_ids=True).collect()
    assert sorted((r.offset, r.sequence_id) for r in rows) == [(0, 0), (2, 0), (4, 0)] and all(len(r.ids) == 2 for r in rows)
    assert p.pack_documents(df.limit(0)).count() == 0
