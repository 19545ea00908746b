"""Text expressions: Turkish casing, folding, tokens, cleaning, chunks and snippets."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented letters and what a folded token has in their place; the dotless i stays.
ACCENTED = "áàâäãåāăąçćčďéèêëēęěğíìîïīñńňóòôöõøōőřśšşťúùûüūůűýÿźžżǧ"
PLAIN = "aaaaaaaaacccdeeeeeeegiiiiinnnoooooooorssstuuuuuuuyyzzzg"
TOKEN = r"[\p{L}\p{N}]+"


def tr_lower(x: Column) -> Column:
    """Turkish lower case: I to dotless i, dotted capital I to i. (A Turkish collation skips pure ASCII texts.)"""
    return F.lower(F.replace(F.replace(x, F.lit("I"), F.lit("ı")), F.lit("İ"), F.lit("i")))


@lru_cache(maxsize=1)
def uncomposed() -> str:
    """A pattern of what composed text doesn't have, or may not have: marks, vowels and finals of Hangul, and characters that stand for others."""
    marks, jamo = r"\p{M}", "\u1161-\u1175\u11a8-\u11c2"
    single = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c) and unicodedata.category(chr(c))[0] != "M"]
    runs: list[list[int]] = []
    for c in map(ord, single):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    # None of them is below U+0300, which is asked first: most characters of most texts end there instead of meeting each run.
    return "[\\x{300}-\\x{10ffff}&&[" + marks + jamo + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]]"


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def composed(x: Column) -> Column:
    """Canonical composition (NFC). Only texts that may need it go to Python; of the others a null does."""
    return F.coalesce(_compose(F.when(x.rlike(uncomposed()), x)), x)


def search_form(x: Column) -> Column:
    """What substring searches compare: composed first, as I and a dot above is a dotted capital I."""
    return tr_lower(composed(x))


def tr_upper(x: Column) -> Column:
    return F.upper(F.translate(x, "iı", "İI"))


def fold(x: Column) -> Column:
    """Lower case without accents, for the token index."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))


def spaced(x: Column) -> Column:
    """The same tokens in one string, with blanks between them and perhaps around them: far less to hand on than a list of strings."""
    return F.regexp_replace(fold(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N} ]+", " ")


def collapse_spaces(x: Column) -> Column:
    # Single blanks, which most are, stay as they are instead of being replaced by themselves.
    return F.trim(F.regexp_replace(x, r"(?U) \s+|[^\S ]\s*", " "))


def clean_text(x: Column) -> Column:
    """Markup to text: tags, six entities, line ends, blanks and blank lines, in this order; null gives an empty text."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("\r\n", "\n")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"(?U)\n\s*\n", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def bind(x: Column, f) -> Column:
    """f of a variable that has x's value: what f uses more than once is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def chunk_text(x: Column, size: int = 800, overlap: int = 150) -> Column:
    """Windows of up to size characters, cut at a space of their last hundred, each overlapping the one before.

    The last chunk repeats the text's last overlap characters, as the windows go on until a chunk is no longer than the overlap."""
    none = F.array().cast("array<string>")
    # A place in a long text is found by counting characters from its start, so places are looked up in blocks of it.
    block = max(BLOCK, size)
    cut = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    parts = bind(collapse_spaces(x), lambda text: bind(
        F.struct(cut(text).alias("blocks"), F.length(text).alias("n"), text.alias("text")), lambda b: _chunks_of(b["blocks"], block, b["text"], b["n"], size, overlap)))
    return F.when(F.coalesce(x, F.lit("")) == "", none).otherwise(parts)


#: Characters of a block; steps of a fold whose results are kept together.
BLOCK, STEPS = 1024, 64


def _chunks_of(blocks: Column, block: int, clean: Column, n: Column, size: int, overlap: int) -> Column:
    """Only places travel through the folds, as start and length of each chunk; texts are cut after them.

    An inner fold makes some chunks, an outer one strings their lists together, so that no list is copied for each chunk."""
    none = F.array().cast("array<struct<start:int,length:int>>")
    steps = F.ceil((n / F.lit(max(1, size - 100 - overlap)) + 2) / STEPS).cast("int")

    def piece(start: Column, length: Column) -> Column:
        at = F.floor(start / block).cast("int")
        return F.substring(F.concat(F.coalesce(F.get(blocks, at), F.lit("")), F.coalesce(F.get(blocks, at + 1), F.lit(""))), start - at * block + 1, length)

    def step(s: Column, _: Column) -> Column:
        # The last hundred characters of the window, backwards: its last space is the first one there.
        tail = F.instr(F.reverse(piece(s["start"] + size - 100, F.lit(100))), " ")
        cut = F.when((s["start"] + size < n) & (tail > 0) & (tail < 100), size - tail).otherwise(F.least(F.lit(size), n - s["start"]))
        return F.when(s["done"], s).otherwise(bind(cut, lambda length: F.struct(
            F.concat(s["chunks"], F.array(F.struct(s["start"].alias("start"), length.alias("length")))).alias("chunks"),
            (s["start"] + length - overlap).alias("start"),
            ((length <= overlap) | (s["start"] + length - overlap >= n)).alias("done"))))

    def some(s: Column, _: Column) -> Column:
        begin = F.struct(none.alias("chunks"), s["start"].alias("start"), s["done"].alias("done"))
        made = lambda m: F.struct(F.concat(s["lists"], F.array(m["chunks"])).alias("lists"), m["start"].alias("start"), m["done"].alias("done"))
        return F.when(s["done"], s).otherwise(bind(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step), made))

    start = F.struct(F.array().cast("array<array<struct<start:int,length:int>>>").alias("lists"), F.lit(0).alias("start"), F.lit(False).alias("done"))
    many = F.flatten(F.aggregate(F.sequence(F.lit(1), steps), start, some, lambda s: s["lists"]))
    return F.when(n <= size, F.array(clean)).otherwise(F.transform(many, lambda c: piece(c["start"], c["length"])))


def sums_before(x: Column) -> Column:
    """For each element of an array of longs the sum of those before it: within blocks, after the sums of the blocks before."""
    none = F.array().cast("array<bigint>")
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, v: s + v)
    fold = lambda b, first: F.aggregate(
        b, F.struct(first.alias("at"), none.alias("out")), lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / STEPS).cast("int")), lambda i: F.slice(x, i * STEPS + 1, STEPS))
    return bind(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(F.transform(bs, total), F.lit(0).cast("long")), fold)))


def find_all(x: Column, pattern: str) -> Column:
    """array<struct<at, value>> of a pattern's matches in order, at counted from 0: pieces between matches give the places."""
    none = F.array().cast("array<struct<at:int,value:string>>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(x, pattern), 1, F.size(found)), lambda g: F.length(g).cast("long"))
        before = lambda b: sums_before(F.zip_with(b["gaps"], b["found"], lambda g, m: g + F.length(m)))
        at = lambda b: F.zip_with(before(b), b["gaps"], lambda s, g: (s + g).cast("int"))
        return bind(F.struct(gaps.alias("gaps"), found.alias("found")), lambda b: F.zip_with(at(b), b["found"], lambda p, m: F.struct(p.alias("at"), m.alias("value"))))

    def single(found: Column) -> Column:
        """Without sums: before the only match stands the first piece."""
        return F.array(F.struct(F.length(F.get(F.split(x, pattern, 2), F.lit(0))).alias("at"), F.get(found, F.lit(0)).alias("value")))

    return bind(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).when(F.size(found) == 1, single(found)).otherwise(placed(found)))


def with_snippet(df: DataFrame, content: str, query: str, out: str = "snippet", budget: int = 180, marks: tuple[str, str] = ("<b>", "</b>")) -> DataFrame:
    """Add a snippet around the query's first match, between whole words, with the budget split 45 to 55 around the match."""
    query = " ".join([query.strip()]) if query else ""
    c, n = F.col("_c"), F.length("_c")
    df = df.withColumn("_c", collapse_spaces(F.coalesce(content, F.lit(""))))
    ellipsis = F.lit("…")
    if not query:
        return df.withColumn(out, F.when(n > budget, F.concat(F.substring(c, 1, budget), ellipsis)).otherwise(c)).drop("_c")
    size = len(query)
    rest = max(0, budget - size)
    left = int(rest * 0.45)
    right = rest - left
    at = F.instr(tr_lower(c), tr_lower(F.lit(query)))
    df = df.withColumn("_m", F.when(at > 0, at).otherwise(F.instr(F.lower(c), F.lower(F.lit(query)))) - 1).withColumn("_e", F.col("_m") + size)
    start, end = F.greatest(F.lit(0), F.col("_m") - left), F.least(n, F.col("_e") + right)
    short, over = F.col("_m") - left < 0, F.col("_e") + right > n
    df = df.withColumn("_a", F.when(~short & over, F.greatest(F.lit(0), start - (F.col("_e") + right - n))).otherwise(start))
    df = df.withColumn("_z", F.when(short, F.least(n, end + left - F.col("_m"))).otherwise(end))
    space = F.locate(" ", c, 1)
    after = F.col("_a") + F.instr(F.substring(c, F.col("_a") + 1, n), " ") - 1  # -1 of instr's 0 is told apart by the bound below
    after_found = F.instr(F.substring(c, F.col("_a") + 1, n), " ") > 0
    head = F.substring(c, F.lit(1), F.col("_z") + 1)
    before = F.length(head) - F.instr(F.reverse(head), " ")
    before_found = F.instr(head, " ") > 0
    df = df.withColumn("_s", F.when((F.col("_a") > 0) & after_found & (after < F.col("_m")), after + 1).otherwise(F.col("_a")))
    df = df.withColumn("_t", F.when((F.col("_z") < n) & before_found & (before > F.col("_e")), before).otherwise(F.col("_z")))
    hit = F.concat(
        F.when(F.col("_s") > 0, ellipsis).otherwise(""), F.substring(c, F.col("_s") + 1, F.col("_m") - F.col("_s")),
        F.lit(marks[0]), F.substring(c, F.col("_m") + 1, F.lit(size)), F.lit(marks[1]),
        F.substring(c, F.col("_e") + 1, F.col("_t") - F.col("_e")), F.when(F.col("_t") < n, ellipsis).otherwise(""))
    cut = F.substring(c, 1, budget + 1)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    miss = F.when(n <= budget, c).otherwise(F.concat(F.substring(c, F.lit(1), F.when((space > 0) & (F.instr(cut, " ") > 0) & (last > 0), last).otherwise(budget)), ellipsis))
    return df.withColumn(out, F.when(c == "", "").when(F.col("_m") >= 0, hit).otherwise(miss)).drop("_c", "_m", "_e", "_a", "_z", "_s", "_t")
