"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from fpindex.llm.urls import long_suffix

ORACLE: dict[str, str] = {}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str) -> str:
    """List of the lower-cased words of a text."""
    return (
        f"list_filter(regexp_split_to_array(translate({text}, '{_UPPER}', '{_UPPER.lower()}'),"
        " '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    )


def shingle_sets(n: int, table: str = "documents") -> str:
    """CTE ``sets(doc_id, s)``: distinct shingles of ``n`` words."""
    return f"""
worded AS MATERIALIZED (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM {table}),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS s
  FROM worded)"""


def components(n: int, percent: int, table: str = "documents") -> str:
    """CTEs up to ``grouped(doc_id, component_id)``."""
    return f"""{shingle_sets(n, table)},
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.x, p.y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sizes sx ON sx.doc_id = p.x JOIN sizes sy ON sy.doc_id = p.y
  WHERE 100 * p.c >= {percent} * (sx.n + sy.n - p.c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM {table}
  UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
grouped AS MATERIALIZED (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


ORACLE["op4_near_duplicates"] = f"""
WITH RECURSIVE {components(4, 80)}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN grouped g USING (doc_id)"""


ORACLE["op7_decontamination"] = f"""
WITH item AS MATERIALIZED (
  SELECT item_id, {words("coalesce(text, '')")} AS w FROM benchmark),
doc AS MATERIALIZED (
  SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
item_shingle AS MATERIALIZED (
  SELECT item_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS q,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM item WHERE len(w) >= 5),
doc_shingle AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_doc, unnest(range(0, len(w) - 4)) AS p,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM doc WHERE len(w) >= 5),
place AS (
  SELECT DISTINCT doc_id, n, greatest(0, least(p - q, n_doc - n)) AS start
  FROM doc_shingle JOIN item_shingle USING (s)),
cut AS MATERIALIZED (
  SELECT doc_id, n, start, w[start + 1:start + n] AS v FROM place JOIN doc USING (doc_id)),
window_count AS MATERIALIZED (
  SELECT doc_id, n, start, s, count(*) AS c FROM (
    SELECT doc_id, n, start,
           unnest(list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' '))) AS s
    FROM cut) GROUP BY ALL),
item_count AS MATERIALIZED (
  SELECT item_id, n, s, count(*) AS c FROM item_shingle GROUP BY ALL),
common AS (
  SELECT a.doc_id, a.n, a.start, b.item_id, sum(least(a.c, b.c)) AS common
  FROM window_count a JOIN item_count b USING (n, s) GROUP BY ALL),
sized AS (
  SELECT c.*, (SELECT len(v) - 4 FROM cut x WHERE x.doc_id = c.doc_id AND x.n = c.n AND x.start = c.start)
              + c.n - 4 - common AS either FROM common c),
good AS (
  SELECT doc_id, item_id, start, n, common / either AS similarity FROM sized
  WHERE common * 100 >= either * 80)
SELECT doc_id, item_id, start, n AS n_words, similarity FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

_LAST = "list_reverse(string_split(host, '.'))"
_TWO = f"(CASE WHEN len({_LAST}) > 1 THEN {_LAST}[2] || '.' || {_LAST}[1] ELSE host END)"


def _strength(children: str, parents: str, key: str) -> str:
    """Scalar sub-query of the prior weight of one level."""
    return f"""(
  SELECT 1 / CASE WHEN d > k THEN least(greatest((s - k) / (d - k), 0.001), 0.5) ELSE 0.1 END - 1 FROM (
    SELECT sum(c.n * (c.good / c.n - p.good / p.n) * (c.good / c.n - p.good / p.n)
               / ((p.good / p.n) * (1 - p.good / p.n))) AS s,
           sum(1 - c.n / p.n) AS k, sum(c.n * (1 - c.n / p.n)) AS d
    FROM {children} c JOIN {parents} p USING ({key})
    WHERE c.n > 0 AND p.good > 0 AND p.good < p.n))"""


ORACLE["op9_url_filter"] = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT page_id, verdict, text FROM parts, (VALUES
    ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'),
    ('block', 'example.org', '/en/1', 'example.org/en/1'), ('allow', 'com', '/fr/', 'com/fr/'),
    ('block', 'com', '/de/', 'com/de/')) r(verdict, rule_host, rule_path, text)
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
ruled AS (
  SELECT page_id, arg_max(text, length(text)) AS rule, arg_max(verdict, length(text)) AS ruled
  FROM fits GROUP BY page_id),
judged AS MATERIALIZED (SELECT p.*, rule, ruled FROM parts p LEFT JOIN ruled USING (page_id)),
hosts AS MATERIALIZED (
  SELECT host, CAST(count(ruled) AS DOUBLE) AS n, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) AS good,
         CASE WHEN regexp_matches({_TWO}, '{long_suffix()}') THEN {_TWO} ELSE {_LAST}[1] END AS suffix,
         CASE WHEN regexp_matches({_TWO}, '{long_suffix()}') AND len({_LAST}) > 2 THEN {_LAST}[3] || '.' || {_TWO}
              ELSE {_TWO} END AS domain
  FROM judged GROUP BY host),
domains AS MATERIALIZED (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS MATERIALIZED (SELECT suffix, 1 AS every, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
total AS MATERIALIZED (SELECT 1 AS every, sum(n) AS n, sum(good) AS good FROM suffixes),
weight AS MATERIALIZED (
  SELECT {_strength("hosts", "domains", "domain")} AS h, {_strength("domains", "suffixes", "suffix")} AS d,
         {_strength("suffixes", "total", "every")} AS s,
         (SELECT CASE WHEN n > 0 THEN good / n ELSE 0.5 END FROM total) AS top),
by_suffix AS (SELECT suffix, (good + top * s) / (n + s) AS prior FROM suffixes, weight),
by_domain AS (
  SELECT domain, (good + prior * d) / (n + d) AS prior FROM weight, domains JOIN by_suffix USING (suffix)),
rated AS (
  SELECT host, (good + prior * h) / (n + h) AS rate, n + h AS w FROM weight, hosts JOIN by_domain USING (domain))
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN rate + 1.645 * sqrt(rate * (1 - rate) / (w + 1)) < 0.5 THEN 'block'
                            ELSE 'allow' END) AS verdict
FROM judged JOIN rated USING (host)"""

ORACLE["op2_top_k"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e, row_number() OVER () AS row
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, q.row AS row, d.vec_id AS vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.row <> d.row AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, row ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM p QUALIFY rank <= 5"""


ORACLE["op12_warc"] = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes,
         min(page_id) OVER (PARTITION BY html) AS first,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '')
           AS payload_digest
  FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM named"""


def _codes(parts: int, entries: int, rounds: int) -> str:
    """SQL of the vector codes: every round compares all parts with all entries."""
    ctes = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x
  FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    for turn in range(rounds + 1):
        ctes.append(f"""
near{turn} AS MATERIALIZED (
  SELECT vec_id, p, min({{'d': d, 'e': e}}) AS m FROM (
    SELECT vec_id, p, e,
           list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d
    FROM part JOIN book{turn} USING (p)) GROUP BY ALL)""")
        if turn < rounds:
            ctes.append(f"""
mean{turn} AS (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(sum(y) AS DOUBLE) AS s, count(*) AS n FROM (
      SELECT p, m.e AS e, unnest(range(len(x))) AS i, unnest(x) AS y
      FROM part JOIN near{turn} USING (vec_id, p)) GROUP BY ALL) GROUP BY ALL),
book{turn + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.c, b.c) AS c FROM book{turn} b LEFT JOIN mean{turn} n USING (p, e))""")
    return f"""
WITH {",".join(ctes)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""


ORACLE["op13_vector_codes"] = _codes(16, 64, 2)
