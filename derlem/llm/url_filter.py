"""URL filter by host reputation.

Explicit rules decide first. Every other page is judged by its host's rate of bad outcomes, which empirical Bayes shrinks:
the counts of a suffix are drawn to the global rate, those of a registered domain to its suffix's posterior mean, those of a
host to its domain's. How strongly each level is drawn (the beta prior's weight) is estimated from the spread that the
level shows beyond binomial noise. A host is blocked if the lower bound of its posterior exceeds a limit, by default the rate of the
whole: such a host is worse than the average page, however few outcomes it has.

For reputation, a host goes without user, port and closing dots. Its suffix is taken from a given list of public suffixes, or by rule:
the last label, or the last two if they are a country's and a general one (co.uk, gov.tr). A number address is its own domain.

Defined cases: a null url, or one without ``://``, has an empty host and path; a url without labelled outcomes on its host
gets the judgement of its domain, suffix or the whole; no outcomes at all: all rates are the prior's half, nothing is
blocked; repeated outcome rows count each; null outcomes are left out. Extra columns of pages are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, durable, lookup_join, table

#: Labels that registries of countries put before their own for all to register below.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "govt", "gv", "mil", "ne", "net", "nom", "or", "org", "sch")

#: (host, path prefix, verdict) as the query's contract states them.
CONTRACT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Reputation:
    """z: standard deviations between posterior mean and lower bound. block_above: lower bounds above this are blocked;
    None: above the rate of all outcomes.
    least_rho, most_rho: limits of the estimated correlation of outcomes within a unit; the prior's weight is 1/rho - 1."""

    z: float = 1.645
    block_above: float | None = None
    least_rho: float = 0.001
    most_rho: float = 0.5


def url_host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """The host without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(:[0-9]*)?$", "")


def _numeric(site: Column) -> Column:
    return site.rlike(r"^[0-9.]+$|^\[")


def suffix_of(site: Column) -> Column:
    last, two = F.substring_index(site, ".", -1), F.substring_index(site, ".", -2)
    general = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(*SECOND_LEVEL) & two.contains(".")
    return F.when(_numeric(site), "(number)").when(general, two).otherwise(last)


def domain_of(site: Column, suffix: Column) -> Column:
    """The suffix and the label before it."""
    labels = F.split(site, r"\.")
    size = F.least(F.size(labels), F.size(F.split(suffix, r"\.")) + 1)
    return F.when(_numeric(site), site).otherwise(F.array_join(F.slice(labels, F.size(labels) - size + 1, size), "."))


def _with_domains(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """hosts(host) -> host, domain, suffix; the longest of the given suffixes that a host ends with."""
    rows = hosts.select("host", site_of(F.col("host")).alias("site"))
    suffix = suffix_of(F.col("site"))
    if suffixes is not None:
        labels = F.split("site", r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
        listed = durable(suffixes.select(ascii_lower(F.col("suffix")).alias("tail")).where("tail is not null").distinct(), "suffixes")
        longest = lookup_join(rows.select("host", F.explode(tails).alias("tail")), listed, "tail", "inner").groupBy("host").agg(F.max_by("tail", F.length("tail")).alias("listed"))
        rows, suffix = rows.join(longest, "host", "left"), F.when(_numeric(F.col("site")), "(number)").otherwise(F.coalesce("listed", suffix))
    return rows.select("host", "site", suffix.alias("suffix")).select("host", "suffix", domain_of(F.col("site"), F.col("suffix")).alias("domain"))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one. rules is a short list, given by the user."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _rho(units: DataFrame, parent: str, at: Reputation) -> float:
    """Correlation of outcomes within a unit around its parent's rate, by the analysis of variance; one row leaves Spark."""
    of_parent = units.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    of_parent = of_parent.where((F.col("pb") > 0) & (F.col("pb") < F.col("pn")))
    rate = F.col("pb") / F.col("pn")
    spread = F.col("n") * (F.col("bad") / F.col("n") - rate) * (F.col("bad") / F.col("n") - rate) / (rate * (1 - rate))
    got = units.join(of_parent, parent).agg(F.sum(spread).alias("s")).first()["s"]
    of = of_parent.agg(F.sum(F.col("k") - 1).alias("dof"), F.sum(F.col("pn") - F.col("nn") / F.col("pn")).alias("size")).first()
    if got is None or of["size"] - of["dof"] <= 0:
        return at.most_rho
    return min(at.most_rho, max(at.least_rho, (got - of["dof"]) / (of["size"] - of["dof"])))


def host_reputation(pages: DataFrame, outcomes: DataFrame, at: Reputation = Reputation(), suffixes: DataFrame | None = None) -> DataFrame:
    """pages(page_id, host), outcomes(page_id, bad 0/1) -> one row per host: n, bad, posterior mean, lower bound, blocked.

    suffixes(suffix): public suffixes, else the rule.

    Outcomes join pages by id, are summed per host before anything else, and only sums move on: a hot host is one row."""
    seen = pages.where("page_id is not null").join(outcomes.where("page_id is not null and bad is not null"), "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    every = _with_domains(pages.select("host").distinct(), suffixes)
    hosts = durable(every.join(seen, "host", "left").select("host", "domain", "suffix", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("all", F.lit(1))
    whole = suffixes.agg(*sums).first()
    mean = ((whole["bad"] or 0) + 0.5) / ((whole["n"] or 0) + 1.0)
    weight = [1 / _rho(u.where("n > 0"), p, at) - 1 for u, p in ((suffixes, "all"), (domains, "suffix"), (hosts, "domain"))]
    suffixes = suffixes.select("suffix", ((F.col("bad") + weight[0] * mean) / (F.col("n") + weight[0])).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + weight[1] * F.col("suffix_rate")) / (F.col("n") + weight[1])).alias("domain_rate"))
    strength = F.col("n") + weight[2]
    rate = (F.col("bad") + weight[2] * F.col("domain_rate")) / strength
    low = F.col("posterior") - at.z * F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (strength + 1))
    return (hosts.join(domains, "domain").withColumn("posterior", rate).withColumn("lower", low)
            .select("host", "n", "bad", "posterior", "lower", (F.col("lower") > (mean if at.block_above is None else at.block_above)).alias("blocked")))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=(), at: Reputation = Reputation(), suffixes: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, bad) -> page_id, host, path, rule, verdict, posterior, lower."""
    host, path = url_host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = durable(host_reputation(parts.select("page_id", "host"), outcomes, at, suffixes).select("host", "posterior", "lower", "blocked"), "reputation")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return lookup_join(parts, judged, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "posterior", "lower")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages; a label of low quality for the row of the same id is a bad outcome."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), outcomes, CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("posterior", 6).alias("posterior"), F.round("lower", 6).alias("lower"))
