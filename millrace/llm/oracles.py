"""DuckDB SQL for the queries whose results SQL can express.

The others (trained models, zstandard, random rounding, entropy spans) are tested
against brute-force versions in tests/llm.
"""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH l AS (
  SELECT doc_id, n, u.pos, list_extract(ls, u.pos) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents) d,
       LATERAL (SELECT unnest(range(1, n + 1)) AS pos) u
), k AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), hot AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP8 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, u.p, u.p + least(10, len(w)) - 1), ' ') AS g
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p) u WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, ks.k, u.p, array_to_string(list_slice(w, u.p, u.p + ks.k - 1), ' ') AS g
  FROM dw, ks, LATERAL (SELECT unnest(range(1, len(w) - ks.k + 2)) AS p) u WHERE len(w) >= ks.k
), occ AS (
  SELECT pos.doc_id, pos.p, pos.k, win.item_id FROM pos JOIN win ON pos.g = win.g AND pos.k = win.k
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, u.p, u.p + 4), ' ') AS g
  FROM dw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS p) u WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS s, doc_id AS t FROM documents
  UNION
  SELECT reach.s, links.b FROM reach JOIN links ON reach.t = links.a
)
SELECT dw.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT s AS doc_id, min(t) AS component_id FROM reach GROUP BY s) c USING (doc_id)
"""

ORACLES = {"op6_line_dedup": OP6, "op8_suffix_decontamination": OP8, "op9_ngram_jaccard": OP9}
