import math
from collections import defaultdict

from pyspark.sql import functions as F

from derlem.llm import url_filter as u


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:end], rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in u.CONTRACT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def reputations(hosts, outcomes, at):
    """host -> lower bound, by loops; outcomes: (host, bad)."""

    def names(host):
        labels = host.split(".")
        two = ".".join(labels[-2:])
        deep = len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in u.SECOND_LEVEL
        return ".".join(labels[-3:]) if deep else two, two if deep else labels[-1]

    sums = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    parent = [{}, {}, {}]
    for host in hosts:
        domain, suffix = names(host)
        parent[0][host], parent[1][domain], parent[2][suffix] = domain, suffix, "all"
        for level, key in enumerate((host, domain, suffix)):
            sums[level][key]
    for host, bad in outcomes:
        domain, suffix = names(host)
        for level, key in enumerate((host, domain, suffix)):
            sums[level][key][0] += 1
            sums[level][key][1] += bad
    weight = []
    for level in range(3):
        groups = defaultdict(list)
        for key, (n, bad) in sums[level].items():
            if n:
                groups[parent[level][key]].append((n, bad))
        got, dof, size, any_ = 0.0, 0.0, 0.0, False
        for rows in groups.values():
            pn, pb = sum(n for n, _ in rows), sum(b for _, b in rows)
            if 0 < pb < pn:
                any_, rate = True, pb / pn
                got += sum(n * (b / n - rate) ** 2 / (rate * (1 - rate)) for n, b in rows)
                dof, size = dof + len(rows) - 1, size + pn - sum(n * n for n, _ in rows) / pn
        rho = min(at.most_rho, max(at.least_rho, (got - dof) / (size - dof))) if any_ and size - dof > 0 else at.most_rho
        weight.append(1 / rho - 1)
    mean = (sum(b for _, b in sums[2].values()) + 0.5) / (sum(n for n, _ in sums[2].values()) + 1)
    out = {None: mean}
    for host in hosts:
        domain, suffix = names(host)
        rate = mean
        for level, key in ((2, suffix), (1, domain), (0, host)):
            n, bad = sums[level][key]
            rate = (bad + weight[level] * rate) / (n + weight[level])
        out[host] = rate - at.z * math.sqrt(rate * (1 - rate) / (sums[0][host][0] + weight[0] + 1))
    return out


def test_query_against_force(spark, sf):
    pages = [(r.page_id, *split(r.url)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    host_of = {i: h for i, h, _ in pages}
    labels = [(host_of[r.doc_id], 1 - r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in host_of]
    at = u.Reputation()
    lower = reputations({h for _, h, _ in pages}, labels, at)
    want = []
    for i, host, path in pages:
        rule, verdict = rule_of(host, path)
        want.append((i, host, path, rule, verdict or ("block" if lower[host] > lower[None] else "allow"), round(lower[host], 6)))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.lower) for r in u.op1_url_reputation(spark, sf).collect()]
    assert sorted(x[:5] for x in got) == sorted(x[:5] for x in want)
    assert all(abs(a[5] - b[5]) < 2e-6 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_odd_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en/", "https://example.com/fr/", "x://b.net/es/q", "x://net/fr/", "x://b.net/de/",
            "x://notnet/es/", "x://h#f", "x://h?q/es/", "a://b://c/d", "x://É.Com/", "x://u\n.net/es/\n?"]
    rows = [(i, url, "h") for i, url in enumerate(urls)] + [(None, "x://b.net/es/q", "h"), (3, "http://", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("n", F.lit(1)).withColumn("bad", F.lit("x"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = sorted(((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in u.filter_urls(pages, none, u.CONTRACT_RULES).collect()), key=repr)
    want = sorted(((i is None, i or 0, *split(url), rule_of(*split(url))[0], rule_of(*split(url))[1] or "allow") for i, url, _ in rows), key=repr)
    assert got == want
    assert u.filter_urls(pages.limit(0), none, u.CONTRACT_RULES).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    pages, outcomes = [], []
    for h in range(30):
        for k in range(40):
            pages.append((len(pages), f"x://h{h}.good{h % 5}.org/{k}"))
            outcomes.append((len(pages) - 1, int(h == 7 or k % 20 == 0)))
    pages += [(len(pages), "x://new.good2.org/"), (len(pages) + 1, "x://h7.good2.org/other")]
    outcomes += [(None, 1), (0, None), (10**9, 1)]
    got = u.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"))
    verdict = {r.host: r.verdict for r in got.collect()}
    assert [h for h, v in verdict.items() if v == "block"] == ["h7.good2.org"]


def test_domains(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com.mx": ("y.com.mx", "com.mx"), "a.b.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"),
            "u:p@shop.x.org:8080": ("x.org", "org"), "x.org.": ("x.org", "org"), "10.0.0.1:80": ("10.0.0.1", "(number)"), "[::1]:80": ("[::1]", "(number)"), "": ("", ""), "a.github.io": ("github.io", "io")}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.domain, r.suffix) for r in u._with_domains(hosts, None).collect()} == want
    listed = spark.createDataFrame([("github.io",), ("IO",), ("uk",), (None,), ("io",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in u._with_domains(hosts, listed).collect()}
    assert got == want | {"a.github.io": ("a.github.io", "github.io"), "a.b.co.uk": ("co.uk", "uk"), "co.uk": ("co.uk", "uk")}


def test_long_urls_and_a_fixed_limit(spark):
    long = "x://h.org/" + "a" * 2_000_000
    pages = spark.createDataFrame([(1, long), (2, "x://h.org/b"), (2, "x://h.org/b")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (2, 1)], "page_id long, bad int")
    got = u.filter_urls(pages, outcomes, at=u.Reputation(block_above=0.01)).collect()
    assert [(len(r.path), r.verdict) for r in sorted(got, key=lambda r: -len(r.path))] == [(2_000_001, "block"), (2, "block"), (2, "block")]
