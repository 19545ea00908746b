"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens (the pieces that merges never cross): a leaf stands for a run of them and has
its characters and tokens, an inner node the sums below it. An edit is located by the sums of characters. Text is pre-tokenised anew from
the last leaf whose beginning the edit cannot have moved (a pre-token looks at most one character past its end) to the first old leaf
boundary behind the edit where the new pre-tokens fall into step with the old ones; from there on both agree, for the pattern only looks
forward. Only that region is encoded, and only the sums above its leaves change. A region that outgrows its leaves by far gets the tree
built anew. The special token, written out, is a pre-token of its own: leaves are never cut inside one, and a region begins far enough
ahead of an edit for any that the edit makes or breaks.

Defined cases: null and empty texts have an empty leaf and no tokens; null edits are no edits; an edit's place and length are cut to
the text as it is by then; edits apply in order; null and repeated doc_ids are rows of their own in ``apply_edits``; an empty table
gives an empty one; ``attach_edits`` drops edits of unknown documents and gives all edits of an id to each of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import SPECIAL, encoder

#: Pre-tokens of a leaf, and the growth of a region at which the tree is built anew.
LEAF, GROWTH = 64, 8
TREE = "doc_id long, text string, chars array<int>, tokens array<int>"


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _ends(text: str, at: int) -> Iterator[int]:
    """Where the pre-tokens from a place on end. The vocabulary cuts a text at its special token first, and each part as a text of its own."""
    while at < len(text):
        special = text.find(SPECIAL, at)
        for m in _pattern().finditer(text, at, len(text) if special < 0 else special):
            yield m.end()
        if special < 0:
            return
        at = special + len(SPECIAL)
        yield at


class Tree:
    """Sums in heap order: node 1 is the root, the leaves are the second half."""

    def __init__(self, text: str, encode, leaf: int = LEAF, sums: tuple[list[int], list[int]] | None = None):
        self.text, self.encode, self.leaf = text, encode, leaf
        if sums:
            self.chars, self.tokens = sums
        else:
            self._build()

    def _firm(self, end: int) -> bool:
        """Whether leaves may be cut here: what stands before a cut is encoded as if the text ended there, which changes runs of white space."""
        return end == len(self.text) or not self.text[end - 1].isspace()

    def _build(self) -> None:
        text, last = self.text, len(self.text)
        found = _ends(text, 0) if SPECIAL in text else (m.end() for m in _pattern().finditer(text))
        ends = [end for end in found if not text[end - 1].isspace() or end == last]  # those that are firm
        cuts = [0, *ends[self.leaf - 1 :: self.leaf]]
        if cuts[-1] != len(self.text) or len(cuts) == 1:
            cuts.append(len(self.text))
        size = 1 << max(0, (len(cuts) - 2).bit_length())
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            self.chars[size + k], self.tokens[size + k] = b - a, self._count(a, b)
        for k in range(size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _count(self, a: int, b: int) -> int:
        return len(self.encode(self.text[a:b])) // 4 if b > a else 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that has the character, and where the leaf begins; the last leaf with any for the end of the text."""
        size, node, begin = len(self.chars) // 2, 1, 0
        at = max(0, min(at, self.chars[1] - 1))
        while node < size:
            left = self.chars[2 * node]
            if at - begin < left:
                node = 2 * node
            else:
                begin, node = begin + left, 2 * node + 1
        return node - size, begin

    def edit(self, start: int, removed: int, inserted: str) -> int:
        """Replace characters; the number of characters that were encoded."""
        old, size = self.chars[1], len(self.chars) // 2
        start = max(0, min(start, old))
        stop = max(start, min(start + removed, old))
        self.text = self.text[:start] + inserted + self.text[stop:]
        ahead = start - 3 - len(SPECIAL)
        first, begin = self.find(ahead) if ahead > 0 else (0, 0)
        # Old leaf boundaries behind the edit, as offsets in the new text.
        shift = len(inserted) - (stop - start)
        last, edge = first, begin
        while last < size and edge < stop:
            edge += self.chars[size + last]
            last += 1
        at, ends = begin, []
        for end in _ends(self.text, begin):
            while last < size and edge + shift < at:
                edge += self.chars[size + last]
                last += 1
            if last > first and at == edge + shift and at >= start + len(inserted) and self._firm(at):
                break
            at = end
            if self._firm(at):
                ends.append(at)
        else:
            last = size
            at = len(self.text)
        leaves = max(1, last - first)
        last = first + leaves
        per = max(1, -(-len(ends) // leaves))
        if per > GROWTH * self.leaf:
            self._build()
            return len(self.text)
        cuts = [begin, *ends[per - 1 :: per]]
        cuts += [at] * (leaves + 1 - len(cuts))
        cuts[leaves] = at
        for k in range(leaves):
            self.chars[size + first + k] = cuts[k + 1] - cuts[k]
            self.tokens[size + first + k] = self._count(cuts[k], cuts[k + 1])
        low, high = (size + first) // 2, (size + last - 1) // 2
        while low >= 1:
            for k in range(low, high + 1):
                self._sum(k)
            low, high = low // 2, high // 2
        return at - begin


def build_trees(docs: DataFrame, vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, chars, tokens: the trees' sums in heap order (element 1 is the whole text's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            trees = [Tree(t.as_py() or "", encode, leaf) for t in batch.column(1)]
            columns = [batch.column(0), batch.column(1), *(pa.array([getattr(t, c) for t in trees], pa.list_(pa.int32())) for c in ("chars", "tokens"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "chars", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREE)


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, position, start, removed, inserted), position their order -> trees with an array of edits, null without any."""
    gathered = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "start", "removed", "inserted"))).alias("e"))
    each = F.transform("e", lambda x: F.struct(x["start"].cast("long").alias("start"), x["removed"].cast("long").alias("removed"), x["inserted"].alias("inserted")))
    return trees.join(gathered.select("doc_id", each.alias("edits")), "doc_id", "left")


def apply_edits(trees: DataFrame, vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """trees with edits: array<struct<start, removed, inserted>> -> trees after the edits, with n_before and n_encoded (characters).

    Rows without chars and tokens, that is, documents with edits, get their trees in the same pass."""
    stored = "chars" in trees.columns and "tokens" in trees.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            trees, before, encoded = [], [], []
            sums = zip(batch.column("chars").to_pylist(), batch.column("tokens").to_pylist(), strict=True) if stored else [None] * batch.num_rows
            for text, edits, own in zip(batch.column("text"), batch.column("edits").to_pylist(), sums, strict=True):
                tree = Tree(text.as_py() or "", encode, leaf, own)
                before.append(tree.total)
                encoded.append(sum(tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "") for e in edits or () if e))
                trees.append(tree)
            columns = [batch.column("doc_id"), pa.array([t.text for t in trees], pa.string()), *(pa.array([getattr(t, c) for t in trees], pa.list_(pa.int32())) for c in ("chars", "tokens")), pa.array(before, pa.int64()), pa.array(encoded, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "chars", "tokens", "n_before", "n_encoded"])

    rows = trees.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits", *(["chars", "tokens"] if stored else []))
    return rows.mapInArrow(run, TREE + ", n_before long, n_encoded long")


def stated_edits() -> Column:
    """The query's edits, by rule: an insertion, a deletion and a replacement at places that a hash of the id chooses."""
    size = F.length(F.coalesce("text", F.lit(""))) + 1
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size).cast("long")
    edit = lambda k, removed, inserted: F.struct(place(k).alias("start"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(edit(1, 0, " newly added words"), edit(2, 7, ""), edit(3, 5, "Édit 42\n"))


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count before and after three stated edits, and how many characters had to be encoded for them."""
    after = apply_edits(table(spark, sf_dir, "documents").select("doc_id", "text", stated_edits().alias("edits")))
    return after.select("doc_id", "n_before", F.col("tokens")[1].cast("long").alias("n_after"), F.col("chars")[1].cast("long").alias("n_chars"), "n_encoded")
