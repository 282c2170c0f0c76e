"""DuckDB SQL of the corpus queries that SQL can express. The others' tests hold them against plain versions."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, unnest(range(1, len(w) - 1)) r(i)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS often FROM tri), (VALUES (0), (1), (2)) v(k) WHERE often > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR 100 * n_repeat_words > 20 * n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS soft_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(CAST(base_failed OR soft_failed AS BIGINT)) AS f FROM r GROUP BY host),
p AS (SELECT avg(CAST(f AS DOUBLE) / n) AS m, var_pop(CAST(f AS DOUBLE) / n) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 1e-12 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 100.0 END AS k FROM p),
s AS (SELECT host, round((f + m * k) / (n + k), 6) AS host_rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (host_rate > 0.5 AND soft_failed) AS kept, soft_failed, host_rate, host_rate > 0.5 AS host_bad
FROM r JOIN s USING (host)
"""

_BITS = "CASE x " + " ".join(f"WHEN '{i:x}' THEN '{i:04b}'" for i in range(16)) + " END"

WARC = f"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[[:cntrl:]]', '', 'g') AS url, sha1(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n),
b AS (SELECT p.*, first, array_to_string(list_transform(string_split(h, ''), lambda x: {_BITS}), '') AS bits FROM p JOIN f USING (h, n))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER) + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url, true AS complete
FROM b
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 2, 2))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

REPEATS = """
WITH b AS (SELECT doc_id, h, length(h) // 2 AS n FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS s FROM b, unnest(range(1, n - 98)) r(i)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
p AS (SELECT b.doc_id, p, substr(h, 2 * p - 1, 2) AS x FROM b, unnest(range(1, n + 1)) r(p)),
l AS (SELECT p.doc_id, p, x, max(c.i) OVER (PARTITION BY p.doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS last FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.p),
g AS (SELECT doc_id, p, x, coalesce(last >= p - 99, false) AS gone FROM l),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM g),
r AS (SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE starts) AS BIGINT) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN r USING (doc_id)
"""
