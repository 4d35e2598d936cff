"""Queries over the star schema: PostgreSQL-flavoured text, run through the engine's dialect.

Each entry is the text, or (text, the same for a second engine where its dialect differs, None where it has no such thing).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

SCANS: dict[str, object] = {
    "scan_full": "SELECT * FROM nation",
    "scan_project": "SELECT c_custkey, c_name FROM customer",
    "pk_point": "SELECT * FROM orders WHERE o_orderkey = 4711",
    "pk_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1999",
    "commuted_predicate": "SELECT o_orderkey FROM orders WHERE 400000 < o_totalprice AND 'F' = o_orderstatus",
    "scan_reverse": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC",
    "filter_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'",
    "filter_in": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "filter_null": "SELECT doc_id FROM documents WHERE text IS NULL OR lang IS NULL",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ri_g%' AND p_type NOT LIKE '%SMALL%'",
    "filter_ilike": "SELECT p_partkey FROM part WHERE p_brand ILIKE 'brand%1%'",
    "filter_regex": ("SELECT c_custkey FROM customer WHERE c_name ~ '0[13579]$' AND c_mktsegment !~ '^B' AND c_name ~* 'CUSTOMER'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[13579]$') AND NOT regexp_matches(c_mktsegment, '^B') AND regexp_matches(c_name, 'CUSTOMER', 'i')"),
    "filter_similar": ("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)%'", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%'"),
    "filter_bool": "SELECT fdw_id, role_oid FROM role_snapshot_history WHERE rolsuper IS NOT TRUE AND rolcanlogin IS TRUE AND (rolbypassrls IS FALSE OR rolinherit IS NOT FALSE)",
    "filter_or_not": "SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey = 3)",
    "filter_any_array": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = ANY (ARRAY['F', 'P']) AND o_custkey <> ALL (ARRAY[1, 2, 3])", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)"),
    "row_compare": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ROW(l_orderkey, l_linenumber) < ROW(50, 3)",
    "case_coalesce": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS state, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l FROM customer",
    "distinct_from": "SELECT count(*) AS n FROM documents WHERE lang IS DISTINCT FROM 'en' AND fmt IS NOT DISTINCT FROM 'srt'",
    "casts": ("SELECT c_custkey, c_custkey::text AS t, c_acctbal::int8 AS i, '12'::int4 + 1 AS j, CAST(c_nationkey AS float8) AS f, (c_acctbal::numeric(12,2))::text AS d FROM customer", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS t, CAST(trunc(c_acctbal) AS BIGINT) AS i, 13 AS j, CAST(c_nationkey AS DOUBLE) AS f, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS d FROM customer"),
    "values_series": ("SELECT g.x AS x, v.name AS name FROM generate_series(1, 20) AS g(x) JOIN (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS v(id, name) ON g.x % 4 = v.id", "SELECT CAST(g.x AS INTEGER) AS x, v.name AS name FROM generate_series(1, 20) AS g(x) JOIN (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS v(id, name) ON g.x % 4 = v.id"),
    "unnest_ordinality": ("SELECT push_id, t.tid AS tid, t.n AS n FROM xid_push, LATERAL unnest(table_ids) WITH ORDINALITY AS t(tid, n)", "SELECT push_id, unnest(table_ids) AS tid, CAST(unnest(range(1, len(table_ids) + 1)) AS INTEGER) AS n FROM xid_push WHERE len(table_ids) > 0"),
    "tablesample": ("SELECT o_orderkey, o_custkey FROM orders TABLESAMPLE BERNOULLI (10) REPEATABLE (7)", None),
}

JOINS: dict[str, object] = {
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000",
    "join_left_anti": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 450000 WHERE o.o_orderkey IS NULL",
    "join_right": "SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "join_right_anti": "SELECT n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000 WHERE s.s_suppkey IS NULL",
    "join_full": "SELECT c.c_custkey, o.o_orderkey FROM customer c FULL OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 40 * c.c_acctbal",
    "join_full_anti": "SELECT c.c_custkey, o.o_orderkey FROM customer c FULL OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 40 * c.c_acctbal WHERE c.c_custkey IS NULL OR o.o_orderkey IS NULL",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_natural": "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) y",
    "join_using": "SELECT k, n_name, s_suppkey FROM (SELECT n_nationkey AS k, n_name FROM nation) x JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) y USING (k)",
    "join_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "join_semi_exists": "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)",
    "join_not_exists": "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09 AND l.l_quantity > 49 AND l.l_tax > 0.07)",
    "join_not_in": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    "join_theta_range": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal AND b.s_acctbal < a.s_acctbal + 2000",
    "join_lateral": "SELECT n.n_name, t.s_suppkey, t.s_acctbal FROM nation n, LATERAL (SELECT s_suppkey, s_acctbal FROM supplier s WHERE s.s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t",
    "join_chain": "SELECT r.r_name, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name",
    "join_null_keys": "SELECT d.doc_id, e.label FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS k FROM documents) d JOIN (SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN NULL ELSE vec_id END AS k FROM embeddings) e ON d.k = e.k",
}

AGGS: dict[str, object] = {
    "agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 20) AS high, round(sum(value) FILTER (WHERE value <= 20), 2) AS low_sum FROM events GROUP BY event_type",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "agg_cube": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "agg_rollup": "SELECT n_regionkey, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "agg_stats": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY l_returnflag",
    "agg_regr": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay, round(regr_sxx(l_tax, l_discount), 4) AS sxx, round(regr_syy(l_tax, l_discount), 4) AS syy, round(regr_sxy(l_tax, l_discount), 4) AS sxy FROM lineitem",
    "agg_bool_bit": "SELECT s_nationkey, bool_and(s_acctbal > 0) AS a, bool_or(s_acctbal < 0) AS o, bit_and(s_suppkey) AS ba, bit_or(s_suppkey) AS bo, bit_xor(s_suppkey) AS bx FROM supplier GROUP BY s_nationkey",
    "agg_every": ("SELECT s_nationkey, every(s_acctbal > -500) AS e FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey, bool_and(s_acctbal > -500) AS e FROM supplier GROUP BY s_nationkey"),
    "agg_percentile": "SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 3) AS med, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1 FROM lineitem GROUP BY l_returnflag",
    "agg_mode": ("SELECT mode() WITHIN GROUP (ORDER BY l_returnflag) AS m FROM (SELECT l_returnflag FROM lineitem UNION ALL SELECT 'R' FROM lineitem) t", "SELECT mode(l_returnflag) AS m FROM (SELECT l_returnflag FROM lineitem UNION ALL SELECT 'R' FROM lineitem) t"),
    "agg_string_ordered": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "agg_array_ordered": ("SELECT s_nationkey, array_to_string(array_agg(s_suppkey ORDER BY s_suppkey), '|') AS keys, cardinality(array_agg(s_acctbal)) AS n FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey, array_to_string(array_agg(s_suppkey ORDER BY s_suppkey), '|') AS keys, CAST(count(*) AS INTEGER) AS n FROM supplier GROUP BY s_nationkey"),
    "agg_array_keeps_nulls": ("SELECT fmt, cardinality(array_agg(cue_count)) AS n FROM documents GROUP BY fmt", "SELECT fmt, CAST(count(*) AS INTEGER) AS n FROM documents GROUP BY fmt"),
    "agg_distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "agg_hypothetical": ("SELECT o_orderstatus, rank(200000.0) WITHIN GROUP (ORDER BY o_totalprice) AS rank_of, dense_rank(200000.0) WITHIN GROUP (ORDER BY o_totalprice) AS dense_of, round(percent_rank(200000.0) WITHIN GROUP (ORDER BY o_totalprice), 8) AS percent_of FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, 1 + count(*) FILTER (WHERE o_totalprice < 200000) AS rank_of, 1 + count(DISTINCT o_totalprice) FILTER (WHERE o_totalprice < 200000) AS dense_of, round(CAST(count(*) FILTER (WHERE o_totalprice < 200000) AS DOUBLE) / count(*), 8) AS percent_of FROM orders GROUP BY o_orderstatus"),
    "agg_json": ("SELECT n_regionkey, json_agg(n_nationkey ORDER BY n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey"),
    "agg_distinct_ordered": ("SELECT l_returnflag, array_to_string(array_agg(DISTINCT l_linenumber ORDER BY l_linenumber DESC), ',') AS d, jsonb_agg(DISTINCT l_linestatus ORDER BY l_linestatus) AS j FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, array_to_string(list(DISTINCT l_linenumber ORDER BY l_linenumber DESC), ',') AS d, '[' || string_agg(DISTINCT '\"' || l_linestatus || '\"', ',' ORDER BY '\"' || l_linestatus || '\"') || ']' AS j FROM lineitem GROUP BY l_returnflag"),
    "agg_array_mixed": "SELECT s_nationkey % 5 AS g, array_to_string(array_agg(s_suppkey ORDER BY s_nationkey DESC, s_suppkey), ',') AS keys FROM supplier GROUP BY s_nationkey % 5",
    "agg_hypothetical_down": ("SELECT c_mktsegment, rank(0.0, 3) WITHIN GROUP (ORDER BY c_acctbal DESC, c_nationkey) AS r, round(cume_dist(0.0) WITHIN GROUP (ORDER BY c_acctbal DESC), 8) AS c FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, 1 + count(*) FILTER (WHERE c_acctbal > 0 OR (c_acctbal = 0 AND c_nationkey < 3)) AS r, round((1 + count(*) FILTER (WHERE c_acctbal >= 0)) / (count(*) + 1), 8) AS c FROM customer GROUP BY c_mktsegment"),
    "agg_range": ("SELECT o_custkey, cardinality(range_agg(tsrange(o_orderdate, o_orderdate + INTERVAL '90' DAY))) AS n, range_upper(range_intersect_agg(tsrange(o_orderdate, o_orderdate + INTERVAL '90' DAY))) AS first_end FROM orders GROUP BY o_custkey",
        "WITH r AS (SELECT o_custkey, o_orderdate AS lo, o_orderdate + INTERVAL '90' DAY AS hi FROM orders), s AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM r) SELECT o_custkey, CAST(sum(n) AS INTEGER) AS n, min(hi) AS first_end FROM s GROUP BY o_custkey"),
    "agg_empty": "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
    "table_statistics": "SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(l_tax) AS n_tax, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem",
}

WINDOWS: dict[str, object] = {
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_rank": "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000.0)) AS r, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000.0)) AS d FROM supplier",
    "win_pct": "SELECT s_suppkey, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)",
    "win_ntile": ("SELECT o_orderkey, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS t FROM orders", "SELECT o_orderkey, CAST(ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS t FROM orders"),
    "win_lag_lead": "SELECT event_id, lag(value, 2, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events",
    "win_first_last_nth": "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_default_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts), 3) AS s, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events",
    "win_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 3) AS s FROM events",
    "win_range": ("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM lineitem", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM lineitem"),
    "win_groups_text": ("SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS 1 PRECEDING) AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)", "SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, CAST(sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"),
    "win_exclude_text": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS t, max(event_id) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS g, min(event_id) OVER (PARTITION BY user_id ORDER BY event_type RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS c, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS f, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 4) AS a FROM events",
    "win_range_interval": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "win_agg": "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders",
}

ORDERS: dict[str, object] = {
    "order_nulls": ("SELECT doc_id, row_number() OVER (PARTITION BY title_key ORDER BY lang, doc_id) AS up, row_number() OVER (PARTITION BY title_key ORDER BY lang DESC, doc_id) AS down, row_number() OVER (PARTITION BY title_key ORDER BY lang NULLS FIRST, doc_id) AS nf FROM documents", "SELECT doc_id, row_number() OVER (PARTITION BY title_key ORDER BY lang ASC NULLS LAST, doc_id) AS up, row_number() OVER (PARTITION BY title_key ORDER BY lang DESC NULLS FIRST, doc_id) AS down, row_number() OVER (PARTITION BY title_key ORDER BY lang ASC NULLS FIRST, doc_id) AS nf FROM documents"),
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 100",
    "fetch_first": "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey FETCH FIRST 7 ROWS ONLY",
    "with_ties": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC FETCH FIRST 5 ROWS WITH TIES", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem) t WHERE r <= 5"),
    "offset_ties": ("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC OFFSET 3 FETCH FIRST 4 ROWS WITH TIES", None),
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "except_all": "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation",
    "scalar_subq": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)",
    "corr_subq": "SELECT s_suppkey, (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) AS n, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS c FROM supplier",
    "any_all_subq": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 5) AND s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 2)", "SELECT s_suppkey FROM supplier WHERE s_acctbal > coalesce((SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = 5), -1e18) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND s_acctbal > (SELECT min(c_acctbal) FROM customer WHERE c_nationkey = 2)"),
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 2000000) SELECT c.c_name, round(top.t, 2) AS t FROM top JOIN customer c ON c.c_custkey = top.o_custkey",
    "cte_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r",
    "cte_recursive_deep": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 350) SELECT n FROM r",
    "cte_cycle": ("WITH RECURSIVE w(f, t) AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey > 4 UNION ALL SELECT n.n_nationkey, n.n_regionkey FROM nation n, w WHERE n.n_nationkey = w.t) CYCLE f, t SET is_cycle USING path SELECT f, t, is_cycle, cardinality(path) AS steps FROM w",
        "WITH RECURSIVE w(f, t, is_cycle, path) AS (SELECT n_nationkey, n_regionkey, false, [(n_nationkey, n_regionkey)] FROM nation WHERE n_nationkey > 4 UNION ALL SELECT n.n_nationkey, n.n_regionkey, list_contains(w.path, (n.n_nationkey, n.n_regionkey)), list_append(w.path, (n.n_nationkey, n.n_regionkey)) FROM nation n, w WHERE n.n_nationkey = w.t AND NOT w.is_cycle) SELECT f, t, is_cycle, CAST(len(path) AS INTEGER) AS steps FROM w"),
    "cte_search": ("WITH RECURSIVE w(f, t) AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n.n_nationkey, n.n_regionkey FROM nation n JOIN w ON n.n_nationkey = w.t WHERE n.n_nationkey > n.n_regionkey) SEARCH DEPTH FIRST BY f, t SET seq SELECT f, t, row_number() OVER (ORDER BY seq) AS place FROM w",
        "WITH RECURSIVE w(f, t, seq) AS (SELECT n_nationkey, n_regionkey, [(n_nationkey, n_regionkey)] FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n.n_nationkey, n.n_regionkey, list_append(w.seq, (n.n_nationkey, n.n_regionkey)) FROM nation n JOIN w ON n.n_nationkey = w.t WHERE n.n_nationkey > n.n_regionkey) SELECT f, t, row_number() OVER (ORDER BY seq) AS place FROM w"),
    "cte_search_breadth": ("WITH RECURSIVE w(f, t) AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n.n_nationkey, n.n_regionkey FROM nation n JOIN w ON n.n_nationkey = w.t WHERE n.n_nationkey > n.n_regionkey) SEARCH BREADTH FIRST BY f SET seq SELECT f, t, rank() OVER (ORDER BY seq) AS place FROM w",
        "WITH RECURSIVE w(f, t, d) AS (SELECT n_nationkey, n_regionkey, 0 FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n.n_nationkey, n.n_regionkey, d + 1 FROM nation n JOIN w ON n.n_nationkey = w.t WHERE n.n_nationkey > n.n_regionkey) SELECT f, t, rank() OVER (ORDER BY d, f) AS place FROM w"),
    "rows_from": ("SELECT a, b, n FROM ROWS FROM (generate_series(1, 4), unnest(ARRAY['x', 'y'])) WITH ORDINALITY AS z(a, b, n)", "SELECT * FROM (VALUES (1, 'x', 1), (2, 'y', 2), (3, NULL, 3), (4, NULL, 4)) z(a, b, n)"),
    "cte_recursive_union": "WITH RECURSIVE reach(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT CAST((k * 5 + 2) % 23 AS BIGINT) FROM reach) SELECT k FROM reach",
    "cte_recursive_path": ("WITH RECURSIVE t(id, up, path) AS (SELECT n_nationkey, n_regionkey, CAST(n_nationkey AS STRING) FROM nation WHERE n_nationkey = 24 UNION ALL SELECT n.n_nationkey, n.n_regionkey, t.path || '>' || CAST(n.n_nationkey AS STRING) FROM nation n JOIN t ON n.n_nationkey = t.up WHERE n.n_nationkey < t.id) SELECT id, path FROM t", "WITH RECURSIVE t(id, up, path) AS (SELECT n_nationkey, n_regionkey, CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 24 UNION ALL SELECT n.n_nationkey, n.n_regionkey, t.path || '>' || CAST(n.n_nationkey AS VARCHAR) FROM nation n JOIN t ON n.n_nationkey = t.up WHERE n.n_nationkey < t.id) SELECT id, path FROM t"),
}

FUNCS: dict[str, object] = {
    "fn_string": ("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS lo, length(c_name) AS n, substr(c_name, 3, 4) AS s, substr(c_name, 0, 3) AS s0, left(c_name, -3) AS l, right(c_name, -10) AS r, lpad(c_mktsegment, 12, '*') AS lp, replace(c_name, '#', ':') AS rp, strpos(c_name, '#') AS p, split_part(c_name, '#', 2) AS sp, reverse(c_mktsegment) AS rv, concat(c_mktsegment, NULL, '!') AS cc, initcap(c_mktsegment) AS ic, repeat('ab', 2) AS rr, translate(c_mktsegment, 'AEI', 'aei') AS tr, btrim('  x ') AS bt FROM customer",
        "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS lo, CAST(length(c_name) AS INTEGER) AS n, substr(c_name, 3, 4) AS s, substr(c_name, 1, 2) AS s0, left(c_name, -3) AS l, right(c_name, -10) AS r, lpad(c_mktsegment, 12, '*') AS lp, replace(c_name, '#', ':') AS rp, CAST(strpos(c_name, '#') AS INTEGER) AS p, split_part(c_name, '#', 2) AS sp, reverse(c_mktsegment) AS rv, c_mktsegment || '!' AS cc, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS ic, 'abab' AS rr, translate(c_mktsegment, 'AEI', 'aei') AS tr, 'x' AS bt FROM customer"),
    "fn_regex": ("SELECT c_custkey, regexp_replace(c_name, '0', 'o') AS one, regexp_replace(c_name, '[0-9]', '', 'g') AS every, regexp_count(c_name, '0') AS n, regexp_substr(c_name, '[1-9][0-9]*') AS d, (regexp_match(c_name, '#(0*)'))[1] AS z FROM customer", "SELECT c_custkey, regexp_replace(c_name, '0', 'o') AS one, regexp_replace(c_name, '[0-9]', '', 'g') AS every, CAST(len(regexp_extract_all(c_name, '0')) AS INTEGER) AS n, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS d, regexp_extract(c_name, '#(0*)', 1) AS z FROM customer"),
    "fn_math": ("SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal)::int8 AS c, floor(s_acctbal)::int8 AS f, round(sqrt(abs(s_acctbal)), 6) AS sq, round(ln(s_suppkey + 1), 8) AS l, round(log(s_suppkey + 1), 8) AS l10, s_suppkey % 7 AS m, s_suppkey / 4 AS q, round(2 ^ (s_nationkey % 5), 4) AS p, sign(s_acctbal)::int4 AS sg, round(trunc(s_acctbal, 1), 4) AS t, gcd(s_suppkey, 12) AS g, round(cbrt(s_suppkey), 8) AS cb, round(degrees(1.0), 8) AS dg FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 6) AS sq, round(ln(s_suppkey + 1), 8) AS l, round(log10(s_suppkey + 1), 8) AS l10, s_suppkey % 7 AS m, s_suppkey // 4 AS q, round(power(2, s_nationkey % 5), 4) AS p, CAST(sign(s_acctbal) AS INTEGER) AS sg, round(trunc(s_acctbal * 10) / 10, 4) AS t, CAST(gcd(s_suppkey, 12) AS BIGINT) AS g, round(cbrt(s_suppkey), 8) AS cb, round(degrees(1.0), 8) AS dg FROM supplier"),
    "fn_date": ("SELECT event_id, extract(year FROM ts) AS y, extract(dow FROM ts) AS dow, extract(isodow FROM ts) AS idow, date_trunc('hour', ts) AS h, to_char(ts, 'YYYY-MM-DD HH24:MI:SS') AS c, ts + INTERVAL '2' DAY AS t2, to_char(ts::date, 'YYYY/MM/DD') AS d, extract(quarter FROM ts) AS q FROM events", "SELECT event_id, CAST(date_part('year', ts) AS INTEGER) AS y, CAST(date_part('dow', ts) AS INTEGER) AS dow, CAST(date_part('isodow', ts) AS INTEGER) AS idow, date_trunc('hour', ts) AS h, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c, ts + INTERVAL '2' DAY AS t2, strftime(ts, '%Y/%m/%d') AS d, CAST(date_part('quarter', ts) AS INTEGER) AS q FROM events"),
    "date_bin_tumbling": ("SELECT date_bin(INTERVAL '15' MINUTE, ts, TIMESTAMP '2024-01-01 00:00:00') AS b, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY date_bin(INTERVAL '15' MINUTE, ts, TIMESTAMP '2024-01-01 00:00:00')", "SELECT time_bucket(INTERVAL '15' MINUTE, ts, TIMESTAMP '2024-01-01 00:00:00') AS b, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY 1"),
    "fn_json": ("SELECT event_id, (props ->> 'k')::int4 AS k, json_typeof(props) AS t, jsonb_exists(props, 'k') AS e, jsonb_set(props, '{k}', '0') AS s, jsonb_contains(props, '{\"k\": 7}') AS has7 FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'object' AS t, true AS e, '{\"k\": 0}' AS s, CAST(json_extract_string(props, '$.k') AS INTEGER) = 7 AS has7 FROM events"),
    "fn_array": ("SELECT push_id, cardinality(table_ids) AS n, table_ids[1] AS head, array_position(table_ids, table_ids[2]) AS pos, array_to_string(array_append(table_ids, 7), ',') AS app, table_ids @> ARRAY[table_ids[1]] AS has FROM xid_push", "SELECT push_id, CAST(len(table_ids) AS INTEGER) AS n, table_ids[1] AS head, CAST(list_position(table_ids, table_ids[2]) AS BIGINT) AS pos, array_to_string(list_append(coalesce(table_ids, []), 7), ',') AS app, CASE WHEN table_ids IS NULL THEN NULL ELSE len(table_ids) > 0 END AS has FROM xid_push"),
    "fn_bit": ("SELECT o_orderkey, o_orderkey & 15 AS a, o_orderkey | 3 AS o, o_orderkey # 9 AS x, ~o_orderkey AS n, bit_count(o_orderkey) AS c, to_hex(o_orderkey) AS h FROM orders", "SELECT o_orderkey, o_orderkey & 15 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 9) AS x, -o_orderkey - 1 AS n, CAST(bit_count(o_orderkey) AS INTEGER) AS c, lower(to_hex(o_orderkey)) AS h FROM orders"),
    "fn_whole_division": ("SELECT o_orderkey, (9007199254740993 + o_orderkey) / 1 AS big, (o_orderkey - 5000) / 7 AS neg, CAST(o_custkey / 2.0 AS FLOAT8) AS half, o_totalprice / 3 AS third FROM orders", "SELECT o_orderkey, 9007199254740993 + o_orderkey AS big, CAST(trunc((o_orderkey - 5000) / 7) AS BIGINT) AS neg, CAST(o_custkey / 2.0 AS FLOAT8) AS half, o_totalprice / 3 AS third FROM orders"),
    "fn_substring_pattern": ("SELECT c_custkey, substring(c_name FROM '#0*([1-9][0-9]*)') AS num, substring(c_name FROM '[A-Z]') AS up, B'101' AS bits FROM customer", "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '#0*([1-9][0-9]*)') THEN regexp_extract(c_name, '#0*([1-9][0-9]*)', 1) END AS num, regexp_extract(c_name, '[A-Z]') AS up, '101' AS bits FROM customer"),
    "fn_md5": ("SELECT c_custkey, md5(c_name) AS h, sha256(c_name) AS s FROM customer", "SELECT c_custkey, md5(c_name) AS h, sha256(c_name) AS s FROM customer"),
    "fn_range": ("SELECT a.s_suppkey AS a, range_overlaps(int8range(a.s_suppkey, a.s_suppkey + 10), int8range(15, 20, '[]')) AS o, range_contains_elem(int8range(a.s_suppkey, a.s_suppkey + 10), cast(15 as bigint)) AS c FROM supplier a", "SELECT s_suppkey AS a, s_suppkey < 21 AND s_suppkey + 10 > 15 AS o, s_suppkey <= 15 AND 15 < s_suppkey + 10 AS c FROM supplier"),
    "fn_typed_operators": ("SELECT s_suppkey, int8pl(s_suppkey, 5) AS p, float8lt(s_acctbal, 0.0) AS lt, int8larger(s_suppkey, 40) AS g, texteq('a', 'a') AS e, btint8cmp(s_suppkey, 50) AS c FROM supplier", "SELECT s_suppkey, s_suppkey + 5 AS p, s_acctbal < 0 AS lt, greatest(s_suppkey, 40) AS g, true AS e, CAST(sign(s_suppkey - 50) AS INTEGER) AS c FROM supplier"),
}

#: whole benchmark-like queries
STAR: dict[str, object] = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "shipping_priority": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-06-01 00:00:00' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "nation_sales": "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name ORDER BY total DESC",
    "forecast_change": "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "sales_by_product": "SELECT p_brand, p_type, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type",
    "large_customers": "SELECT c_name, o_orderkey, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) GROUP BY c_name, o_orderkey",
}

ALL = SCANS | JOINS | AGGS | WINDOWS | ORDERS | FUNCS | STAR


def _runner(text: str):
    words = set(re.findall(r"\w+", text))

    def run(spark: SparkSession, d: str) -> DataFrame:
        names = [t for t in (*TABLES, "xid_push", "role_snapshot_history") if t in words]
        return Engine.over(spark, d, *names).sql(text)

    return run


def _text(v: object, i: int) -> str | None:
    return v if isinstance(v, str) else v[i]


QUERIES = {k: _runner(_text(v, 0)) for k, v in ALL.items()}
SQL = {k: q for k, v in ALL.items() if (q := _text(v, 1)) is not None}
