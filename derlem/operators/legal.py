"""Legal metadata of documents: court, case number, type, date and parties, as column expressions over text and filename."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal_rules as r
from ..functions.text import bind, find_all, tr_lower, tr_upper


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _first(items: Column) -> Column:
    """The first element that isn't null or empty; null without one."""
    return F.get(F.filter(items, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def _any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(operator.or_, [F.contains(x, F.lit(w)) for w in words])


def type_key(x: Column) -> Column:
    return _key(tr_lower(x))


def _key(low: Column) -> Column:
    return F.trim(F.regexp_replace(low, "[^a-z0-9çğıöşü]+", " "))


def _title_key(title: str) -> str:
    """type_key of a title from the table."""
    return " ".join(re.findall("[a-z0-9çğıöşü]+", title.replace("I", "ı").replace("İ", "i").lower()))


#: All keys with their types as one text, which Spark turns into a map once.
_TYPES = ";".join(f"{_title_key(title)}{end}={kind}" for title, kind in r.TITLES for end in ("", "dir", "idir"))


_TITLE_KEYS = sorted({pair.partition("=")[0] for pair in _TYPES.split(";")})


def canonical_type(key: Column) -> Column:
    """The type that a normalised title names, with an ending of the copula or without; null for others."""
    return F.try_element_at(F.str_to_map(F.lit(_TYPES), F.lit(";"), F.lit("=")), key)


def _clean_line(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1f\x7f]", ""), r"^[|;:©]+\s*", "")
    x = F.regexp_replace(x, r"(?iu)MAHK\s+EMES([İI])", "MAHKEMES$1")
    x = F.regexp_replace(x, r"(?iu)İCRA\s+D(?:\.|\s)+A[İI]RES([İI])", "İCRA DAİRES$1")
    x = F.regexp_replace(x, r"(?iu)DEĞİŞİ\s+K\s+İŞ", "DEĞİŞİK İŞ")
    return F.trim(F.regexp_replace(x, r"\s+\d{2}[./-]\d{2}[./-]\d{4}\s*$", ""))


def court(text: Column) -> Column:
    lines = F.slice(F.split(text, r"\r?\n"), 1, 50)
    units = F.flatten(F.transform(lines, lambda x: F.split(x, "\t")))
    # Most lines go before they are cleaned; what is left after cleaning has a stem, and isn't empty then.
    units = F.filter(units, lambda u: bind(F.lower(u), lambda low: _any(low, r.AUTHORITY_PARTS)) | u.rlike(r"[\x00-\x1f\x7f]"))
    units = F.transform(units, lambda u: F.regexp_replace(_clean_line(u), r"(?i)^t\.?\s*c\.?\s+", ""))
    units = F.filter(units, lambda u: u.rlike(r.AUTHORITY_STEMS))
    tried = lambda u, low: F.coalesce(*[F.when(_any(low, need), _some(F.regexp_extract(u, p, 1))) for p, need in zip(r.AUTHORITIES, r.AUTHORITY_NEEDS, strict=True)])
    name = _first(F.transform(units, lambda u: bind(F.lower(u), lambda low: tried(u, low))))
    name = F.regexp_replace(F.regexp_replace(F.trim(name), r"(?i)^t\.?\s*c\.?\s+", ""), r"(?i)['’]?\s*(?:ne|na)$", "")
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\bMAHK\.", "MAHKEMESİ"), r"\s+", " ")


def references(low: Column) -> Column:
    """A text in lower case with the reading errors of scanned references mended."""
    for pattern, put in ((r"dosya[ \t]+n[ \t]*o\b", "dosya no"), (r"değişi[ \t]+k[ \t]+iş", "değişik iş"), (r"mah[ \t]*k[ \t]+emesi", "mahkemesi"), (r"icra[ \t]+d\.?[ \t]*airesi", "icra dairesi")):
        low = F.regexp_replace(low, pattern, put)
    return low


def case(low: Column, zone: Column) -> Column:
    """struct<number, kind> of the first case number, of those that begin a line if there are any. low: a column of ``references``, zone: its
    first 3000 characters; both are used often and must be columns of the table, not expressions."""

    def candidates(where: Column, pattern: str, words: tuple[str, ...], kind: str, order: int, structural, valid=None, needs: tuple[tuple[str, ...], str] | None = None) -> Column:
        may = _any(where, words)
        if needs:
            may = may & (_any(where, needs[0]) | where.rlike(needs[1]))
        found = F.when(may, find_all(where, pattern)).otherwise(F.array().cast("array<struct<at:int,value:string>>"))
        rows = F.transform(found, lambda m: F.struct(
            (~structural(m)).alias("loose"), m["at"].alias("at"), F.lit(order).alias("order"), F.lit(kind).alias("kind"),
            F.regexp_extract(m["value"], pattern, 1).try_cast("int").alias("year"),
            F.regexp_replace(F.regexp_extract(m["value"], pattern, 2), r"[ \t]", "").try_cast("int").alias("seq"),
            (valid(m) if valid else F.lit(True)).alias("valid")))
        return F.filter(rows, lambda c: c["year"].between(1980, 2100) & (c["seq"] > 0) & c["valid"])

    line = lambda m: F.trim(F.substring_index(F.substring(low, F.lit(1), m["at"]), "\n", -1)) == ""
    before = lambda m: F.substring_index(F.substring(zone, F.greatest(F.lit(1), m["at"] - 44), F.least(F.lit(45), m["at"])), "\n", -1)
    tail = lambda m: F.substring(zone, m["at"] + F.length(m["value"]) + 1, F.lit(60))
    bare = lambda m: ~before(m).rlike(r.AUTHORITY_BEFORE) & ~tail(m).rlike(r.CITATION_TAIL) & F.substring(zone, m["at"], F.lit(1)).isin(" ", "\t")
    parts = [candidates(low, p, r.CASE_WORDS[i], kind, i, line, needs=r.CASE_NEEDS.get(i)) for i, (kind, p) in enumerate(r.CASE_LABELS)]
    parts += [candidates(zone, p, ("sayı",), kind, 20 + i, lambda m: F.lit(True)) for i, (kind, p) in enumerate(r.CASE_HEADERS)]
    parts.append(candidates(zone, r.CASE_BARE, ("esas",), "ESAS", 30, lambda m: F.lit(False), bare))
    best = F.array_min(F.flatten(F.array(*parts)))
    return bind(best, lambda b: F.when(b.isNotNull(), F.struct(F.concat_ws("/", b["year"], b["seq"]).alias("number"), b["kind"].alias("kind"))))


def heading_type(low: Column) -> Column:
    """low: a text in Turkish lower case. Only lines with a part that a title has are made keys; a title's key is shorter than eighty characters."""
    lines = F.filter(F.split(F.substring_index(low, "\n", 80), "\n"), lambda x: _any(x, r.TITLE_PARTS))
    return canonical_type(_first(F.filter(F.transform(lines, _key), lambda k: k.isin(*_TITLE_KEYS))))


def structural_type(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for (kind, families, guards), words in zip(reversed(r.STRUCTURES), reversed(r.STRUCTURE_WORDS), strict=True):
        may = [_any(low, some) for some in words]
        count = lambda found: sum((x.cast("int") for x in found), F.lit(0)) >= 2
        enough = count(may) & count([m & low.rlike(p) for m, p in zip(may, families, strict=True)])
        guarded = F.lit(False)
        for g in guards:
            guarded = guarded | low.rlike(g)
        out = F.when(enough & ~guarded, kind).otherwise(out)
    return out


def date_near(text: Column, low: Column, words, within: int) -> Column:
    """The first date within so many characters of a word's first place, words in turn, as DD.MM.YYYY."""

    def one(word: str) -> Column:
        at = F.instr(low, word)
        found = F.when(at > 0, F.regexp_extract(F.substring(text, at, F.lit(within)), r.DATE, 0))
        return bind(F.split(found, r"[./\-]"), lambda d: F.when(F.size(d) == 3, F.concat_ws(".", F.lpad(d[0], 2, "0"), F.lpad(d[1], 2, "0"), d[2])))

    return F.coalesce(*map(one, words))


def document_date(text: Column, low: Column, kind: Column) -> Column:
    own = F.lit(None).cast("string")
    for name, words in r.DATE_WORDS:
        own = F.when(kind == name, date_near(text, low, words, 100)).otherwise(own)
    return F.coalesce(own, date_near(text, low, r.GENERAL_DATE_WORDS, 80))


def parties(text: Column) -> Column:
    """struct<plaintiff, defendant>: of the first hundred lines, the first label with a role of each; a later label with both roles is the defendant's."""
    shape = r"^\s*([^:\t]{2,70})\s*[:\t]+\s*(.*)$"
    lines = F.filter(F.slice(F.split(text, r"\r?\n"), 1, 100), lambda x: x.rlike(shape))
    has = lambda label, roles: label.rlike("|".join(roles))

    def value(x: Column) -> Column:
        def cut(x: Column, cuts) -> Column:
            for pattern, put in cuts:
                x = F.regexp_replace(x, pattern, put)
            return F.trim(x)

        return bind(F.regexp_extract(x, shape, 2), lambda x: F.when(x.rlike(r.PARTY_CUT_SIGNS), cut(x, r.PARTY_CUTS)).otherwise(cut(x, r.PARTY_CUTS[-1:])))

    rows = F.transform(lines, lambda x: F.struct(tr_upper(F.trim(F.regexp_extract(x, shape, 1))).alias("label"), x.alias("line")))
    rows = F.filter(rows, lambda p: has(p["label"], r.PLAINTIFF_ROLES + r.DEFENDANT_ROLES) & ~p["label"].rlike("(?iu)(?:VEK[İIıi]L|M[ÜUuü]DAF[İIıi])"))
    # Values are made of the few lines whose label has a role.
    rows = F.transform(rows, lambda p: F.struct(value(p["line"]).alias("value"), has(p["label"], r.PLAINTIFF_ROLES).alias("p"), has(p["label"], r.DEFENDANT_ROLES).alias("d")))
    rows = F.filter(rows, lambda p: F.length(p["value"]) >= 2)
    state = F.struct(F.lit(None).cast("string").alias("plaintiff"), F.lit(None).cast("string").alias("defendant"))

    def step(s: Column, p: Column) -> Column:
        first = s["plaintiff"].isNull() & p["p"]
        return F.struct(
            F.when(first, p["value"]).otherwise(s["plaintiff"]).alias("plaintiff"),
            F.when(~first & s["defendant"].isNull() & p["d"], p["value"]).otherwise(s["defendant"]).alias("defendant"))

    return F.aggregate(rows, state, step)


def filename_evidence(stem: Column) -> Column:
    """struct<number, kind, type, date> of a file name like 2024_780_Type_06_05_2024; null fields if it isn't one."""
    part = [F.regexp_extract(stem, r.FILENAME, i) for i in range(7)]
    good = (part[0] != "") & part[1].try_cast("int").between(1980, 2100) & (part[2].try_cast("int") > 0)
    raw = F.trim(F.regexp_replace(F.replace(part[3], F.lit("_"), F.lit(" ")), r"\s+", " "))
    known = canonical_type(type_key(raw))
    return F.struct(
        F.when(good, F.concat_ws("/", part[1].try_cast("int"), part[2].try_cast("int"))).alias("number"), F.when(good, "ESAS").alias("kind"),
        F.when(good, F.coalesce(known, raw)).alias("type"), F.when(good & (part[6] != ""), F.concat_ws(".", part[4], part[5], part[6])).alias("date"))


FIELDS = ("court_name", "case_number", "case_kind", "document_type", "document_date", "plaintiff", "defendant")


def extract_metadata(docs: DataFrame, text: str = "body", filename: str = "filename") -> DataFrame:
    """docs with seven metadata columns; the text decides first, the file name fills what it leaves open."""
    # What several fields read is a column of its own and made once; a projection is only merged into the next where it is used once.
    docs = docs.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_low", tr_lower(F.col("_t")))
    docs = docs.withColumn("_ref", references(F.col("_low"))).withColumn("_zone", F.substring("_ref", 1, 3000))
    t, low = F.col("_t"), F.col("_low")
    stem = F.trim(F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^/.]+$", ""))
    docs = docs.withColumn("_stem", stem).withColumn("_f", filename_evidence(F.col("_stem"))).withColumn("_c", case(F.col("_ref"), F.col("_zone"))).withColumn("_p", parties(t))
    subject = F.regexp_extract(F.substring(t, 1, 3000), r.SUBJECT, 1)
    subject = _some(F.trim(F.regexp_replace(F.substring(subject, 1, 150), r"\s+", " ")))
    empty = F.trim(t) == ""
    kind = F.coalesce(F.when(~empty, F.coalesce(heading_type(low), structural_type(low))), F.col("_f.type"), F.when(~empty, subject), _some(F.trim(F.substring("_stem", 1, 100))))
    docs = docs.withColumn("court_name", _some(court(t))).withColumn("document_type", kind)
    docs = docs.withColumn("case_number", F.coalesce("_c.number", "_f.number")).withColumn("case_kind", F.coalesce("_c.kind", "_f.kind"))
    docs = docs.withColumn("document_date", F.coalesce(document_date(t, low, F.col("document_type")), F.col("_f.date")))
    docs = docs.withColumn("plaintiff", F.col("_p.plaintiff")).withColumn("defendant", F.col("_p.defendant"))
    return docs.drop("_f", "_c", "_p", "_t", "_low", "_ref", "_zone", "_stem")
