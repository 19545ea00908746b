"""DuckDB SQL with the results of the queries that SQL can express."""

OP1 = r"""
WITH p0 AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p0),
h0 AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.*(:[0-9]*)?$', '') AS site, count(*) FILTER (quality IS NOT NULL) AS n,
              coalesce(sum(1 - quality), 0)::BIGINT AS bad FROM p LEFT JOIN labels ON page_id = doc_id GROUP BY host),
h1 AS (SELECT host, site, string_split(site, '.') AS l, n, bad, regexp_matches(site, '^[0-9.]+$|^\[') AS numeric FROM h0),
h2 AS (SELECT *, CASE WHEN numeric THEN '(number)' WHEN length(l[-1]) = 2 AND len(l) > 1 AND l[-2] IN ('ac','co','com','edu','gen','go','gob','gouv','gov','govt','gv','mil','ne','net','nom','or','org','sch')
                 THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h1),
h AS (SELECT host, n, bad, suffix, CASE WHEN numeric THEN site ELSE array_to_string(l[greatest(1, len(l) - len(string_split(suffix, '.'))):], '.') END AS domain FROM h2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, 1 AS one, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
w AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS mean FROM s),
u AS (SELECT 1 AS level, 'all' AS parent, n, bad FROM s WHERE n > 0 UNION ALL SELECT 2, suffix, n, bad FROM d WHERE n > 0
      UNION ALL SELECT 3, domain, n, bad FROM h WHERE n > 0),
up AS (SELECT level, parent, sum(n)::DOUBLE AS pn, sum(bad)::DOUBLE AS pb, count(*) AS k, sum(n * n)::DOUBLE AS nn FROM u GROUP BY ALL HAVING sum(bad) > 0 AND sum(bad) < sum(n)),
dof AS (SELECT level, sum(k - 1)::DOUBLE AS dof, sum(pn - nn / pn) AS size FROM up GROUP BY level),
sp AS (SELECT level, sum(n * (bad / n - pb / pn) * (bad / n - pb / pn) / ((pb / pn) * (1 - pb / pn))) AS s FROM u JOIN up USING (level, parent) GROUP BY level),
rho AS (SELECT level, CASE WHEN s IS NULL OR size - dof <= 0 THEN 0.5 ELSE least(0.5, greatest(0.001, (s - dof) / (size - dof))) END::DOUBLE AS rho FROM sp JOIN dof USING (level)),
k AS (SELECT 1 / coalesce(max(rho) FILTER (level = 1), 0.5::DOUBLE) - 1 AS k1, 1 / coalesce(max(rho) FILTER (level = 2), 0.5::DOUBLE) - 1 AS k2,
             1 / coalesce(max(rho) FILTER (level = 3), 0.5::DOUBLE) - 1 AS k3 FROM rho),
sr AS (SELECT suffix, (bad + k1 * mean) / (n + k1) AS suffix_rate FROM s, k, w),
dr AS (SELECT domain, (bad + k2 * suffix_rate) / (n + k2) AS domain_rate FROM d JOIN sr USING (suffix), k),
hr AS (SELECT host, n + k3 AS strength, (bad + k3 * domain_rate) / (n + k3) AS posterior FROM h JOIN dr USING (domain), k),
hl AS (SELECT host, posterior, posterior - 1.645::DOUBLE * sqrt(posterior * (1 - posterior) / (strength + 1)) AS lower FROM hr),
hv AS (SELECT host, posterior, lower, CASE WHEN lower > mean THEN 'block' ELSE 'allow' END AS by_host FROM hl, w),
r AS (SELECT p.*, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE by_host END AS verdict, round(posterior, 6) AS posterior, round(lower, 6) AS lower
FROM r JOIN hv USING (host)
"""

OP7 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
c AS (SELECT r, doc_id, lang, len(words)::BIGINT AS n_words, length(text) AS n_chars, words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             [length(text) - length(regexp_replace(text, '[a-z]', '', 'g')), length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')),
              length(text) - length(regexp_replace(text, '[0-9]', '', 'g')), length(text) - length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')),
              length(text) - length(regexp_replace(text, '[.,;:!?''\x22()-]', '', 'g')), length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))] AS k FROM w),
h AS (SELECT r, lang, 'c' AS what, unnest(list_append(k, n_chars - list_sum(k)::BIGINT)) AS v, unnest(range(7)) AS i FROM c
      UNION ALL
      SELECT r, lang, 'w', unnest(list_append(m, n_words - list_sum(m)::BIGINT)), unnest(range(33)) FROM (
        SELECT r, lang, n_words, list_transform(['the','of','and','to','in','is','that','for','de','la','le','et','les','des','en','un','der','die','und','den','von','zu','das','mit','que','el','y','los','del','se','para','con'],
               lambda q: len(list_filter(words, lambda x: x = q))::BIGINT) AS m FROM c)),
ref AS (SELECT lang, what, i, sum(v)::DOUBLE AS v FROM h GROUP BY ALL),
refsum AS (SELECT lang, what, sum(v) AS total FROM ref GROUP BY ALL),
own AS (SELECT r, what, sum(v)::DOUBLE AS total FROM h GROUP BY ALL),
pq AS (SELECT h.r, h.what, h.v / own.total AS p, ref.v / refsum.total AS q FROM h JOIN own USING (r, what) JOIN ref USING (lang, what, i) JOIN refsum USING (lang, what)
       WHERE own.total > 0 AND refsum.total > 0),
d AS (SELECT r, what, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d FROM pq GROUP BY ALL),
win AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT r, words, unnest(range(1, n_words - 3)) AS i FROM c)),
twice AS (SELECT r, i FROM win JOIN (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY r),
f AS (SELECT c.*, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dc.d, 0) AS dc, coalesce(dw.d, 0) AS dw FROM c LEFT JOIN rep USING (r)
      LEFT JOIN d AS dc ON dc.r = c.r AND dc.what = 'c' LEFT JOIN d AS dw ON dw.r = c.r AND dw.what = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ((n_chars >= 200 AND dc > 0.28) OR (n_words >= 50 AND dw > 0.45)) AS kept
FROM f
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i+least(13, len(w))-1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
windows AS (SELECT r, size, i, array_to_string(w[i:i+size-1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
hit AS (SELECT r, size, i, item_id FROM windows JOIN items USING (size, g)),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, unnest(range(size)) AS j FROM hit) GROUP BY r),
f AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN f USING (r)
"""

OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
gone AS (SELECT doc_id, i FROM win JOIN (SELECT g, min(doc_id) AS least FROM win GROUP BY g) USING (g) WHERE doc_id > least),
cover AS (SELECT DISTINCT doc_id, i + j AS i FROM gone, (SELECT unnest(range(13)) AS j)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN cover USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, source || '/' || lang AS repo, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, 0 AS kind, regexp_extract_all(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
             regexp_split_to_array(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g FROM t
      UNION ALL SELECT r, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}'), regexp_split_to_array(text, 'AKIA[A-Z0-9]{16,}') FROM t
      UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_split_to_array(text, '[0-9a-f]{24,}') FROM t
      UNION ALL SELECT r, 3, regexp_extract_all(text, '[A-Za-z0-9_+/-]{20,}'), regexp_split_to_array(text, '[A-Za-z0-9_+/-]{20,}') FROM t),
e AS (SELECT r, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM s WHERE len(m) > 0),
f AS (SELECT r, kind, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS a FROM e),
k AS (SELECT r, kind, a, a + length(v) AS b, CASE WHEN kind = 0 THEN regexp_extract(v, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) ELSE v END AS v FROM f),
ok AS (SELECT * FROM k WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') ELSE true END),
own AS (SELECT kind, v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT coalesce(repo, '')) AS repos, owners <= 1 AND repos <= 3 AS live FROM ok JOIN t USING (r) GROUP BY kind, v),
l AS (SELECT ok.*, live, owners, repos FROM ok JOIN own USING (kind, v)),
new AS (SELECT * FROM l WHERE kind = 3 AND live AND NOT EXISTS (SELECT 1 FROM l AS b WHERE b.kind < 3 AND b.r = l.r AND b.a < l.b AND l.a < b.b)),
n AS (SELECT ['assign', 'access', 'hex', 'token'] AS names),
sp AS (SELECT r, string_agg(names[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b) AS spans FROM (SELECT r, kind, a, b FROM l WHERE kind < 3 UNION ALL SELECT r, kind, a, b FROM new), n GROUP BY r),
ba AS (SELECT r, string_agg(names[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b) AS base, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2 FROM l, n WHERE kind < 3 GROUP BY r),
nl AS (SELECT r, count(*) FILTER (live) AS n, max(owners) AS owners, max(repos) AS repos FROM l GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(nl.n, 0) AS n_live,
       coalesce(nl.owners, 0) AS most_owners, coalesce(nl.repos, 0) AS most_repositories
FROM t LEFT JOIN ba USING (r) LEFT JOIN sp USING (r) LEFT JOIN nl USING (r)
"""

_QUANTISED = "list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11 = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, {_QUANTISED} AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda x: x[1] * x[2]))::BIGINT AS score FROM v AS q JOIN v ON q.r <> v.r WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


def _lloyd(centroids: int = 16, rounds: int = 3) -> str:
    """Vectors as a row for each component; each round a pair of tables, assignments and centroids."""
    parts = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, {_QUANTISED} AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {centroids}))"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT r, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, c{i}),
a{i} AS (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS k FROM a{i} JOIN v USING (r)) GROUP BY c, k),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    last = f"""SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""
    return "WITH " + ",\n".join(parts) + "\n" + last


OP12 = _lloyd()

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v))::HUGEINT AS p
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT) // ((sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT + 2 * any_value(v)))::HUGEINT AS q FROM n JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
           ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS r FROM term QUALIFY r <= 10
"""

ORACLE = {
    "op8_secret_ownership": OP8,
    "op7_quality_divergence": OP7,
    "op4_decontaminate": OP4,
    "op3_substring_dedup": OP3,
    "op1_url_reputation": OP1,
    "op11_va_topk": OP11,
    "op12_weighted_lloyd": OP12,
    "op13_source_divergence": OP13,
}
