"""All queries of the library outside llm, and the DuckDB SQL that says the same."""

from __future__ import annotations

from ..functions import scalar, table_functions, udfs
from ..operators import intervals, recursion, relational, sequences, sketches, skew, vectors, windows
from ..sources import layout, range_files, sinks
from ..streaming import events, funnel, upsert

QUERIES = {name: f for module in (relational, windows, intervals, recursion, skew, vectors, sequences, sketches, scalar, udfs, table_functions, sinks, range_files, layout, events, funnel, upsert) for name, f in sorted(vars(module).items()) if name.startswith("c") and name[1:3].isdigit()}

_TUMBLING = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
_SESSIONS = """
SELECT user_id, min(ts) AS start, count(*) AS n, max(ts) AS last FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
) GROUP BY user_id, s"""

ORACLES = {
    "c01_scan": "SELECT * FROM customer",
    "c02_projection": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS net, l_quantity > 25 AS large FROM lineitem",
    "c03_filter": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (1, 5, 9, 14, 30) AND p_brand LIKE 'Brand#%' AND p_retailprice BETWEEN 900 AND 1800",
    "c04_region_revenue": """
SELECT r_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name""",
    "c05_outer_joins": """
WITH d AS (SELECT doc_id FROM documents WHERE lang <> 'fr'), l AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT kind, has_doc, has_label, count(*) AS n FROM (
  SELECT 'left' AS kind, d.doc_id IS NOT NULL AS has_doc, l.doc_id IS NOT NULL AS has_label FROM d LEFT JOIN l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'right', d.doc_id IS NOT NULL, l.doc_id IS NOT NULL FROM d RIGHT JOIN l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'full', d.doc_id IS NOT NULL, l.doc_id IS NOT NULL FROM d FULL JOIN l ON d.doc_id = l.doc_id
) GROUP BY ALL""",
    "c06_semi_join": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "c07_anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "c08_range_join": """
SELECT p_partkey, count(*) AS n_customers, min(c_custkey) AS first_customer FROM part
JOIN customer ON CAST(round(c_acctbal * 100) AS BIGINT) BETWEEN CAST(round(p_retailprice * 100) AS BIGINT) - 500 AND CAST(round(p_retailprice * 100) AS BIGINT) + 500 GROUP BY p_partkey""",
    "c09_asof_join": """
SELECT c.event_id, c.user_id, v.event_id AS view_id, v.ts AS view_ts
FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
    "c10_cross_join": "SELECT n_name, r_name FROM nation, region",
    "c11_lateral": "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)",
    "c12_subqueries": """
SELECT o_orderkey, o_totalprice FROM orders o
WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "c13_aggregate": """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
  round(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_discount, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "c14_distinct_aggregate": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_linenumber)) AS pairs FROM lineitem GROUP BY l_returnflag",
    "c15_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "c16_rollup": """
SELECT CAST(y AS INTEGER) AS year, o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(grouping_id(y, o_orderstatus) AS BIGINT) AS gid
FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY ROLLUP (y, o_orderstatus)""",
    "c16_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "c17_percentiles": "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority",
    "c19_pivot": """
SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P
FROM orders GROUP BY o_orderpriority""",
    "c19_unpivot": "SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part",
    "c20_ranking": """
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(ntile(4) OVER w AS INTEGER) AS quarter,
  CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS rnk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS dense
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""",
    "c21_analytic": """
SELECT event_id, lag(event_id) OVER w AS prev_id, lead(event_type, 2, 'none') OVER w AS later_type,
  first_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_id, last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "c22_frames": """
SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last3,
  count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM events""",
    "c23_sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "c23_top_per_group": "SELECT o_orderpriority, o_orderkey, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    "c24_union": "SELECT kind, nation, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY ALL",
    "c25_intersect": "SELECT l_orderkey AS k FROM lineitem INTERSECT SELECT o_orderkey FROM orders",
    "c25_intersect_all": "SELECT l_linenumber, count(*) AS n FROM (SELECT l_linenumber FROM lineitem INTERSECT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'A') GROUP BY l_linenumber",
    "c25_except": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "c25_except_all": "SELECT l_linenumber, count(*) AS n FROM (SELECT l_linenumber FROM lineitem EXCEPT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'A') GROUP BY l_linenumber",
    "c26_strings": """
SELECT p_partkey, upper(p_name) AS up, regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no, string_split(p_type, ' ')[1] AS first_word, length(p_name) AS len,
  lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, replace(p_brand, '#', '-') AS dashed, substring(p_name, 1, 3) || '/' || reverse(p_brand) AS mixed FROM part""",
    "c27_dates": """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(isodow(o_orderdate) AS INTEGER) AS iso_day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  CAST(o_orderdate AS DATE) + 45 AS due, CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS age, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders""",
    "c28_math": """
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS whole, round(sqrt(l_quantity), 6) AS root, round(pow(l_quantity, 1.5), 4) AS power, round(log10(l_extendedprice + 1), 6) AS log10,
  abs(l_quantity - 25) AS off, l_orderkey % 7 AS mod7, NOT l_quantity > 10 AS small FROM lineitem""",
    "c29_vectors": """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT label, arg_min(v, vec_id) AS h FROM v GROUP BY label)
SELECT vec_id, round(list_dot_product(v, h) / sqrt(list_dot_product(v, v) * list_dot_product(h, h)), 4) AS cosine, CAST(len(v) AS BIGINT) AS dims FROM v JOIN h USING (label)""",
    "c30_json": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
  '{"event_id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS json FROM events""",
    "c31_urls": r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) END AS query FROM pages""",
    "c32_recursion": """
WITH RECURSIVE pairs AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 48 AND l_discount >= 0.08),
links AS (SELECT a AS src, b AS dst FROM pairs UNION SELECT b, a FROM pairs),
reach(node, hops) USING KEY (node) AS (
  SELECT 's' || s_suppkey, 0 FROM supplier WHERE s_nationkey < 5
  UNION
  SELECT dst, min(reach.hops) + 1 FROM reach JOIN links ON src = node WHERE dst NOT IN (SELECT node FROM recurring.reach) GROUP BY dst)
SELECT node, CAST(hops AS INTEGER) AS hops FROM reach""",
    "c33_tumbling": _TUMBLING,
    "c34_sliding": "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS start FROM events, range(2) r(k)) GROUP BY start",
    "c35_session": f"SELECT user_id, start, n FROM ({_SESSIONS})",
    "c36_tumbling": f"SELECT * FROM ({_TUMBLING}) WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'",
    "c37_session": f"SELECT user_id, start, n FROM ({_SESSIONS}) WHERE last + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'",
    "c38_dedup": "SELECT DISTINCT event_id, user_id FROM events",
    "c39_stream_join": "SELECT c.event_id AS click_id, b.event_id AS buy_id FROM events c JOIN events b ON b.user_id = c.user_id AND b.ts >= c.ts AND b.ts <= c.ts + INTERVAL '1 hour' WHERE c.event_type = 'click' AND b.event_type = 'purchase'",
    "c40_state": "SELECT user_id, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY user_id",
    "c41_late_rows": "SELECT start, n FROM (SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL '10 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'",
    "c42_pandas_udf": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * (100 + CAST(round(l_tax * 100) AS BIGINT)) / 1e6 AS charge FROM lineitem",
    "c42_arrow_udf": "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) % 97 AS check_digits, upper(o_orderpriority) AS priority FROM orders",
    "c43_grouped_map": "SELECT o_orderkey, round(round(o_totalprice * 100) / sum(round(o_totalprice * 100)) OVER (PARTITION BY o_custkey), 6) AS share FROM orders",
    "c43_partition_map": "SELECT o_orderpriority, count(*) AS n, max(o_custkey) AS top FROM orders GROUP BY o_orderpriority",
    "c44_udtf": "SELECT p_partkey, CAST(pos - 1 AS INTEGER) AS pos, words[pos] AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part), LATERAL (SELECT unnest(range(1, len(words) + 1)) AS pos)",
    "c50_parquet": "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 2)",
    "c50_csv": "SELECT * FROM nation",
    "c50_json": "SELECT * FROM nation",
    "c50_orc": "SELECT * FROM nation",
    "c50_csv_pages": r"""SELECT page_id, url, html, CASE WHEN page_id % 2 = 0 THEN '' WHEN page_id % 3 = 0 THEN '\ "a", ' || chr(13) || chr(10) || ' b' END AS note FROM pages""",
    "c50_json_events": "SELECT * FROM events",
    "c50_parquet_lineitem": "SELECT l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus",
    "c51_session_overlap": """
WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY us) AS run
  FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us) < 86400000000 THEN 0 ELSE 1 END AS new FROM e)),
s AS (SELECT user_id, event_type, min(us) AS f, max(us) AS l, count(*) AS n FROM r GROUP BY user_id, event_type, run)
SELECT v.user_id, v.f AS view_first, v.l AS view_last, v.n AS view_n, c.f AS click_first, c.l AS click_last, c.n AS click_n
FROM s v JOIN s c ON v.user_id = c.user_id AND v.f <= c.l AND c.f <= v.l WHERE v.event_type = 'view' AND c.event_type = 'click'""",
    "c52_funnel": """
WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events),
v AS (SELECT user_id, us AS view_us, lead(us) OVER w AS next_us, row_number() OVER w AS n_views FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY us)),
c AS (SELECT v.*, min(e.us) AS click_us FROM v JOIN e ON e.user_id = v.user_id AND e.event_type = 'click' AND e.us > view_us AND (next_us IS NULL OR e.us < next_us) GROUP BY ALL),
b AS (SELECT c.*, min(e.us) AS buy_us FROM c JOIN e ON e.user_id = c.user_id AND e.event_type = 'purchase' AND e.us > click_us AND (next_us IS NULL OR e.us < next_us) GROUP BY ALL)
SELECT user_id, view_us, click_us, buy_us, n_views FROM b
WHERE buy_us - view_us <= 604800000000 AND (buy_us + 999) // 1000 <= (SELECT max(us) // 1000 - 600000 FROM e)""",
    "c53_upsert": """
SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type <> 'error'""",
    "c54_session_summary": """
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS sum_event_id, max(event_id) AS max_event_id, CAST(sum(cents) AS BIGINT) AS sum_cents, max(cents) AS max_cents
FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '86400 seconds' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run""",
    "c54_session_batches": """
SELECT user_id, min(us) AS first, max(us) AS last, count(*) AS n
FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS run FROM (SELECT user_id, epoch_us(ts) AS us,
  CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 86400000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run""",
    "c55_range_files": "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'",
    "c56_skew_join": """
SELECT s_nationkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE l_suppkey END AS suppkey, l_quantity FROM lineitem) JOIN supplier ON suppkey = s_suppkey GROUP BY s_nationkey""",
    "c57_nearest_vectors": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_distance(q.x, v.x), 6) AS distance FROM v q, v WHERE q.vec_id % 50 = 0)
SELECT query, CAST(rank AS INTEGER) AS rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) WHERE rank <= 10""",
    "c58_event_sequence": """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type,
  lead(event_type) OVER w AS t1, lead(event_type, 2) OVER w AS t2, lead(epoch_us(ts), 2) OVER w AS end_us, row_number() OVER w AS rn,
  sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS others FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ends AS (SELECT user_id, others, rn, end_us FROM e WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase')
SELECT ends.user_id, min(e.us) AS first, ends.end_us AS last, count(*) + 2 AS n FROM ends JOIN e
  ON e.user_id = ends.user_id AND e.event_type = 'view' AND e.others = ends.others AND e.rn <= ends.rn AND ends.end_us - e.us <= 172800000000 GROUP BY ends.user_id, ends.rn, ends.end_us""",
    "c59_gap_filling": """
WITH m AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t_s, floor(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS mean FROM events GROUP BY ALL),
g AS (SELECT event_type, unnest(range(lo, hi + 1, 3600)) AS t_s FROM (SELECT event_type, min(t_s) AS lo, max(t_s) AS hi FROM m GROUP BY event_type)),
j AS (SELECT g.event_type, g.t_s, m.mean, CASE WHEN m.mean IS NOT NULL THEN g.t_s END AS known FROM g LEFT JOIN m ON m.event_type = g.event_type AND m.t_s = g.t_s),
f AS (SELECT *, last_value(mean IGNORE NULLS) OVER b AS filled, last_value(known IGNORE NULLS) OVER b AS a_at, first_value(mean IGNORE NULLS) OVER a AS next_mean, first_value(known IGNORE NULLS) OVER a AS b_at FROM j
  WINDOW b AS (PARTITION BY event_type ORDER BY t_s ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY event_type ORDER BY t_s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, t_s, mean, filled, round(CASE WHEN mean IS NOT NULL THEN mean ELSE filled + (next_mean - filled) * ((t_s - a_at) / (b_at - a_at)) END, 6) AS linear FROM f""",
    "c60_sketch_rollup": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY event_type",
    "c61_bucketed_join": "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "c62_replaced_partitions": """
SELECT CAST(ship_year AS INTEGER) AS ship_year, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, any_value(orders_of_year) AS orders_of_year
FROM (SELECT l_orderkey, l_quantity, year(l_shipdate) AS ship_year FROM lineitem) JOIN (SELECT year(o_orderdate) AS y, count(*) AS orders_of_year FROM orders GROUP BY 1) ON ship_year = y
WHERE y BETWEEN 1996 AND 1998 AND (ship_year <> 1997 OR l_orderkey % 2 = 0) GROUP BY ship_year""",
}
