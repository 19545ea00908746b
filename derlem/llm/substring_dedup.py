"""Substring dedup: words covered by a window of consecutive words that also starts in a document with a smaller id go.

A count-min prefilter keeps the exact pass small. Rows are dealt into blocks evenly, by their number in the table, whatever is in them. Each block sketches its windows:
a row of counters addressed by a window's hash, of which only those that are not zero are kept, as sorted and delta-coded addresses.
The row is wide (at least 128 counters for each window of the corpus), so one row is enough: with so few windows sharing a
counter, a second row would double the shuffle to spare under one in a hundred false alarms. Sketches are cut by address range, merged
range by range (never in one place), and each block gets back one bit for each of its counters: whether the merged count is
two or more. Counts only overestimate, so no repeated window is lost.

The exact pass shuffles only windows whose estimate is two or more, once for each block and window with the least doc_id that the
block has for it, under 104-bit identities (two independent polynomials of 64-bit word hashes). A hot window is one row from each
block, whatever its copies. Again one bit comes back for each: whether a smaller doc_id has the window elsewhere.

docs must be a table that is read, in an order that a second reading repeats (a durable one, else). Texts are shuffled once, into blocks of bounded size, which three passes of one query read (Spark reuses the exchange).

Defined cases: null and blank texts have no words and keep an empty text; a null doc_id counts as larger than any other; rows that
repeat a doc_id don't count as smaller than each other; an empty table gives an empty one; columns other than doc_id and text are
left out; texts of fewer words than a window are kept whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import next_pow2_bits, partitions, table

WIDTH = 13
#: Bytes of text in a block, and windows that meet in a range of addresses, on average: up to GROW_FROM bytes of text, then in proportion
#: to the root of the size up to the greatest, so that what a block has for a range stays worth a row (some 250 windows at 30 GB, 190 at 1 TB,
#: 5 at 100 TB, where memory is the limit).
BLOCK_BYTES, RANGE_WINDOWS = 4 << 20, 2 << 20
MOST_BLOCK_BYTES, MOST_RANGE_WINDOWS, GROW_FROM = 64 << 20, 8 << 20, 30 << 30
#: Bits of counters beyond those for the corpus's windows: 128 counters for each.
SPARE_BITS = 7
NO_ID = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each over all (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_WINDOW_BASES = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word of some bytes."""
    word = ~_GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, dtype=np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    power = np.full(int(size.max()), _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    letters = _BYTE[data[word]] * power[np.arange(int(size.sum())) - np.repeat(first, size)]
    return start, end, _mix(np.add.reduceat(letters, first) + size.astype(np.uint64))


class _Block:
    """The words and windows of a block's documents."""

    def __init__(self, docs: pa.Table, width: int):
        self.texts = [(t or "").encode() for t in docs.column("text").to_pylist()]
        ids = docs.column("doc_id").to_pylist()
        self.ids, hashes, count, batch, size = ids, [], [], [], 0
        for i, text in enumerate(self.texts):
            batch.append(text)
            size += len(text)
            if size >= 1 << 20 or i + 1 == len(self.texts):
                data = np.frombuffer(b"\n".join(batch), dtype=np.uint8)
                start, _, h = _word_hashes(data)
                ends = np.cumsum([len(t) + 1 for t in batch])
                count.append(np.diff(np.searchsorted(start, ends), prepend=0))
                hashes.append(h)
                batch, size = [], 0
        self.n_words = np.concatenate(count) if count else np.zeros(0, dtype=np.int64)
        words = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        doc = np.repeat(np.arange(len(ids)), self.n_words)
        last = len(words) - width + 1
        self.at = np.flatnonzero(doc[:last] == doc[width - 1 :]) if last > 0 else np.zeros(0, dtype=np.int64)
        self.doc = order[doc[self.at]]
        self._words, self._width, self.one = words, width, self._windows(words, width, _WINDOW_BASES[0])

    def _windows(self, words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
        total = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for j in range(width):
            total = total * base + words[j : len(words) - width + 1 + j]
        return _mix(total[self.at])

    def counters(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The addresses that are not zero, their counts, and which one each window has."""
        found, which, count = np.unique(self.one >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return found, count, which

    def suspects(self, repeated: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows with a repeated counter, by identity: both hashes and the least id in this block; and all such windows with the identity that each has."""
        at = np.flatnonzero(repeated[which])
        one, doc = self.one[at], self.doc[at]
        two = self._windows(self._words, self._width, _WINDOW_BASES[1])[at] >> np.uint64(24)
        order = np.lexsort((doc, two, one))
        one, two, doc, at = one[order], two[order], doc[order], at[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return one[new], two[new], doc[new], at, np.cumsum(new) - 1


def _pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Unsigned numbers, sorted if delta, as compressed bytes; bytes of the same place stand together."""
    if delta and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if delta else values


def _bits(flags: np.ndarray) -> bytes:
    return pa.compress(np.packbits(flags).tobytes(), codec="zstd", asbytes=True)


def _flags(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=(n + 7) // 8, codec="zstd", asbytes=True)
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def _cuts(sorted_hashes: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each of 2**ranges address ranges begins, and the end."""
    lows = np.arange(1, 1 << ranges, dtype=np.uint64) << np.uint64(bits - ranges)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, lows), [len(sorted_hashes)]))


_SKETCH = "block long, range long, n long, one binary, two binary, doc binary"
_BACK = "block long, kind int, range long, n long, bits binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(fields)})


def _read_back(back: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((r for r in back.to_pylist() if r["kind"] == kind), key=lambda r: r["range"])
    return np.concatenate([np.zeros(0, dtype=bool), *(_flags(r["bits"], r["n"]) for r in rows)])


def _sketch(bits: int, ranges: int, width: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found, _, _ = _Block(docs, width).counters(bits)
        cut = _cuts(found, bits, ranges)
        return _rows(_SKETCH, [(key[0].as_py(), r, int(b - a), _pack(found[a:b], True), None, None) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

    return run


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """Which of each block's counters are not zero in another block too."""
    rows = rows.to_pylist()
    parts = [_unpack(r["one"], r["n"], True) for r in rows]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for r, own in zip(rows, parts, strict=True):
        flags = np.zeros(len(own), dtype=bool)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            flags = twice[at] == own
        out.append((r["block"], 0, r["range"], r["n"], _bits(flags)))
    return _rows(_BACK, out)


def _suspects(bits: int, ranges: int, width: int):
    def run(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        block = _Block(docs, width)
        _, count, which = block.counters(bits)
        one, two, doc, _, _ = block.suspects((count > 1) | _read_back(back, 0), which)
        cut = _cuts(one, 64, ranges)
        out = [(key[0].as_py(), r, int(b - a), _pack(one[a:b], True), _pack(two[a:b]), _pack(doc[a:b].astype(np.uint64))) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        # The bits of the sketch travel on under a key of the block's own: the last pass needs them again.
        out += [(r["block"], -1 - r["block"], r["n"], r["bits"], r["range"].to_bytes(8, "little"), None) for r in back.to_pylist()]
        return _rows(_SKETCH, out)

    return run


def _least(key: tuple, rows: pa.Table) -> pa.Table:
    """Which of each block's windows start in a document of smaller id in another block."""
    rows = rows.to_pylist()
    if key[0].as_py() < 0:
        return _rows(_BACK, [(r["block"], 0, int.from_bytes(r["two"], "little"), r["n"], r["one"]) for r in rows])
    one = np.concatenate([_unpack(r["one"], r["n"], True) for r in rows])
    two = np.concatenate([_unpack(r["two"], r["n"]) for r in rows])
    doc = np.concatenate([_unpack(r["doc"], r["n"]) for r in rows]).astype(np.int64)
    order = np.lexsort((doc, two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    larger = np.empty(len(order), dtype=bool)
    larger[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    ends = np.cumsum([r["n"] for r in rows])
    return _rows(_BACK, [(r["block"], 1, r["range"], r["n"], _bits(larger[e - r["n"] : e])) for r, e in zip(rows, ends, strict=True)])


def _cut_words(bits: int, width: int):
    def run(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        block = _Block(docs, width)
        _, count, which = block.counters(bits)
        _, _, doc, at, of = block.suspects((count > 1) | _read_back(back, 0), which)
        gone = at[(block.doc[at] > doc[of]) | _read_back(back, 1)[of]]
        cover = np.zeros(int(block.n_words.sum()) + 1, dtype=np.int64)
        np.add.at(cover, block.at[gone], 1)
        np.add.at(cover, block.at[gone] + width, -1)
        removed = np.cumsum(cover)[:-1] > 0
        out, at_word = [], 0
        for i, text, n in zip(block.ids, block.texts, block.n_words.tolist(), strict=True):
            flags = removed[at_word : at_word + n]
            at_word += n
            words, m = text.split(), int(flags.sum())
            kept = words if not m else [words[k] for k in np.flatnonzero(~flags)]
            out.append((i, n, m, b" ".join(kept).decode()))
        return _rows(_OUT, out)

    return run


_OUT = "doc_id long, n_words long, n_removed long, kept string"


def dedup_substrings(docs: DataFrame, width: int = WIDTH, block_bytes: int | None = None, range_windows: int | None = None, spare_bits: int = SPARE_BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept: the words that stay, joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grown = max(1.0, size / GROW_FROM) ** 0.5
    block_bytes = block_bytes or int(min(MOST_BLOCK_BYTES, BLOCK_BYTES * grown))
    range_windows = range_windows or int(min(MOST_RANGE_WINDOWS, RANGE_WINDOWS * grown))
    windows = size / 4  # words of three letters and a space, or longer
    bits = min(56, max(16, next_pow2_bits(windows) + spare_bits))
    ranges = min(bits - 8, next_pow2_bits(windows / range_windows))
    n_blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks))
    blocks = docs.select(block.alias("block"), "doc_id", "text").repartition(partitions(docs.sparkSession), "block")
    by_block = blocks.groupBy("block")
    sketches = by_block.applyInArrow(_sketch(bits, ranges, width), _SKETCH)
    twice = sketches.groupBy("range").applyInArrow(_merge, _BACK)
    suspects = by_block.cogroup(twice.groupBy("block")).applyInArrow(_suspects(bits, ranges, width), _SKETCH)
    back = suspects.groupBy("range").applyInArrow(_least, _BACK)
    return by_block.cogroup(back.groupBy("block")).applyInArrow(_cut_words(bits, width), _OUT)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
