"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP6 = """
WITH RECURSIVE n AS (
  SELECT source AS src, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source
), rates AS (
  SELECT src, (SELECT sum(n) FROM n)::DOUBLE * (w / (SELECT sum(w) FROM n)) / n AS rate FROM n
), draws AS (
  SELECT src, greatest(ceil(rate / 16.0), 1)::INT AS draws, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rates
), terms(src, mean, k, p, c) AS (
  SELECT src, mean, 0, exp(-mean), exp(-mean) FROM draws
  UNION ALL
  SELECT src, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < 80
), u AS (
  SELECT d.doc_id, r.src, j.j,
         ('0x' || substr(md5('mix-1:' || j.j || ':' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN draws r ON d.source IS NOT DISTINCT FROM r.src, LATERAL (SELECT unnest(range(1, r.draws + 1)) AS j) j
), counts AS (
  SELECT u.doc_id, count(t.k) AS n FROM u LEFT JOIN terms t ON t.src IS NOT DISTINCT FROM u.src AND t.c <= u.u GROUP BY u.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS copy,
       ('0x' || substr(md5('mix-1:order:' || d.doc_id || ':' || c.copy), 1, 15))::BIGINT AS shuffle_key
FROM documents d JOIN (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM counts) c USING (doc_id)
"""


#: Base 32 from hexadecimal: five digits make four letters.
OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p
), top AS (
  SELECT hex, max(page_id) AS top FROM d WHERE payload_bytes >= 0 GROUP BY hex
), coded AS (
  SELECT d.*, top.top, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d.hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), 'string_agg', '') AS b32
  FROM d LEFT JOIN top USING (hex)
)
SELECT page_id, payload_bytes, b32 AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM coded
"""


#: Links over shared shingles (by their 64-bit hashes), then the least id reachable by widening steps.
OP8 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::UBIGINT[] WHEN len(w) < 4 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:])[:len(w) - 3], lambda z: hash(z))) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS rep, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), shingles AS (
  SELECT rep, n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT rep, rep FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least_rep AS (
  SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a
), of_doc AS (
  SELECT s.doc_id, c.rep FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) s JOIN classes c USING (s)
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN of_doc o USING (doc_id) LEFT JOIN least_rep l USING (rep)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_poisson_mixing": OP6, "op8_minmax_near_dedup": OP8, "op10_warc_zstd": OP10}
