"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as q
from . import topk
from . import url_filter as u
from . import warc


def op1() -> str:
    p, each = q.ALPHA / len(q.GRID), sum(map(len, q.GRID.values()))
    grid = ", ".join(f"('{s}', {c}::DOUBLE)" for s, cuts in q.GRID.items() for c in cuts)
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{s}' AS signal, {s} AS value FROM s" for s in q.GRID)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, lang AS stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
b AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN c USING (doc_id)),
s AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
             n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
             n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS long_words,
             -(word_chars / greatest(n_words, 1)) AS short_words FROM b),
m AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
f AS ({long}),
v(signal, cut) AS (VALUES {grid}),
o AS (SELECT doc_id, stratum, signal, max(value) AS value FROM f JOIN m USING (doc_id) JOIN (SELECT doc_id, stratum, base_failed FROM s) USING (doc_id, stratum)
      WHERE good AND NOT base_failed GROUP BY doc_id, stratum, signal),
k AS (SELECT stratum, signal, cut, count(*) AS n, count(*) FILTER (value > cut) AS k FROM o JOIN v USING (signal) GROUP BY stratum, signal, cut),
a AS (SELECT stratum, signal, min(cut) AS cut FROM k
      WHERE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) <= {q.DELTA} / ((SELECT count(DISTINCT stratum) FROM k) * {each})
      GROUP BY stratum, signal),
x AS (SELECT f.doc_id, bool_or(coalesce(value > cut, FALSE)) AS over FROM f LEFT JOIN a USING (stratum, signal) GROUP BY f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept, stratum
FROM s JOIN x USING (doc_id)"""


def op4() -> str:
    link, site = u.LINK.replace("'", "''"), lambda c: f"regexp_replace(regexp_replace({c}, '{u.USER}', ''), '{u.PORT}', '')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in u.RULES)
    steps = ""
    for k in range(u.STEPS):
        last = f"r{k - 1}" if k else "start"
        steps += f"""
r{k} AS (SELECT kind, host, sum(r) AS r FROM (SELECT e.kind, e.dest AS host, {u.DAMPING} * x.r * e.w AS r FROM {last} x JOIN edges e USING (kind, host)
       UNION ALL SELECT kind, host, {1 - u.DAMPING} * r FROM start) GROUP BY kind, host),"""
    return rf"""
WITH p AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(v, rh, rp) AS (VALUES {rules}),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
j AS (SELECT h.page_id, host, {site("host")} AS site, path, rule, v FROM h LEFT JOIN m USING (page_id)),
seeds AS (SELECT site AS host, (count(*) FILTER (v = 'allow')) / count(*) AS t, (count(*) FILTER (v = 'block')) / count(*) AS d FROM j WHERE site <> '' GROUP BY site),
links0 AS (SELECT {site("src")} AS src, {site("translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS dst
           FROM (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS dst FROM h)),
linked AS (SELECT src, dst, count(*)::DOUBLE AS w FROM links0 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
hosts AS (SELECT site AS host FROM j WHERE site <> '' UNION SELECT dst FROM linked),
named AS (SELECT string_split(host, '.') AS n FROM hosts WHERE NOT regexp_matches(host, '{u.ADDRESS}')),
up AS (SELECT DISTINCT array_to_string(n[i:], '.') AS src, array_to_string(n[i + 1:], '.') AS dst FROM (SELECT n, unnest(range(1, len(n) - 1)) AS i FROM named)),
links AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM linked UNION ALL SELECT src, dst, 1.0 FROM up UNION ALL SELECT dst, src, 1.0 FROM up) GROUP BY src, dst),
edges AS (SELECT 't' AS kind, src AS host, dst AS dest, w / sum(w) OVER (PARTITION BY src) AS w FROM links
          UNION ALL SELECT 'd', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM links),
start AS (SELECT 't' AS kind, host, t AS r FROM seeds WHERE t > 0 UNION ALL SELECT 'd', host, d FROM seeds WHERE d > 0),{steps}
s AS (SELECT host, sum(CASE WHEN kind = 't' THEN r ELSE 0 END) AS t, sum(CASE WHEN kind = 'd' THEN r ELSE 0 END) AS d FROM r{u.STEPS - 1} GROUP BY host)
SELECT page_id, j.host, path, rule,
       coalesce(v, CASE WHEN coalesce(d, 0) > {u.THRESHOLD} * (coalesce(t, 0) + coalesce(d, 0)) AND coalesce(d, 0) >= {u.LEAST} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON j.site = s.host"""


def op9() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % {topk.EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {topk.K}"""


def op8() -> str:
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, coalesce(url, '') AS url, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= {warc.LEAST} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to, url
FROM d LEFT JOIN m USING (payload_digest)"""
