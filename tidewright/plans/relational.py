"""Analytical queries over the order and event tables: one text for Spark, one for DuckDB.

Most texts serve both engines. Money is summed as DECIMAL and cast at the end, so that the order of
addition cannot show; orders that feed a limit are total; null placement is written out.
"""

from __future__ import annotations

PRICE = "cast(l_extendedprice as decimal(15,2))"
REVENUE = "cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2)))"
TOTAL = "cast(o_totalprice as decimal(15,2))"

#: One text for both engines.
SHARED: dict[str, str] = {
    # scans, projections, filters
    "scan_region": "SELECT * FROM region",
    "project_arithmetic": "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS twice, -l_quantity AS neg, l_quantity / 4 AS quarter FROM lineitem",
    "filter_comparisons": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 400000 AND o_orderstatus <> 'O' AND o_orderdate >= DATE '1996-01-01' AND o_custkey < o_totalprice",
    "filter_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 10 + 5",
    "filter_in_list": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND extract(month FROM o_orderdate) IN (1, 2, 3) GROUP BY o_orderpriority",
    "filter_null_or_in": "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE seg IN ('MACHINERY', 'AUTOMOBILE') OR seg IS NULL",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type LIKE 'P%'",
    "filter_not_like": "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '%LOW%' AND o_orderpriority NOT LIKE '5%'",
    "filter_ilike": "SELECT c_custkey FROM customer WHERE c_name ILIKE 'CUSTOMER%1'",
    "filter_is_null": "WITH t AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT 'null' AS kind, count(*) AS n, sum(c_custkey) AS keys FROM t WHERE seg IS NULL UNION ALL SELECT 'not null', count(*), sum(c_custkey) FROM t WHERE seg IS NOT NULL",
    "filter_or_blocks": "SELECT cast(sum(" + REVENUE + ") AS double) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 15 AND l_quantity >= 1 AND l_quantity <= 21) OR (p_partkey = l_partkey AND p_size BETWEEN 10 AND 30 AND l_quantity >= 10 AND l_quantity <= 40)",
    "filter_modulo": "SELECT event_id, user_id FROM events WHERE user_id % 10 = 3",
    "filter_date_window": "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '3' MONTH",
    "filter_columns": "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_suppkey",
    "filter_empty_string": "SELECT count(*) AS n FROM events WHERE event_type <> ''",
    "cte_used_twice": "WITH r(supplier_no, total) AS (SELECT l_suppkey, sum(" + REVENUE + ") FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '3' MONTH GROUP BY l_suppkey) SELECT s_suppkey, s_name, cast(total AS double) AS total_revenue FROM supplier, r WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM r)",
    "derived_table": "SELECT big, count(*) AS n FROM (SELECT o_custkey, count(*) > 10 AS big FROM orders GROUP BY o_custkey) t GROUP BY big",
    # joins
    "join_inner": "SELECT l_orderkey, cast(sum(" + REVENUE + ") AS double) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate",
    "join_snowflake": "SELECT n_name, cast(sum(" + REVENUE + ") AS double) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name",
    "join_wide": "SELECT r1.r_name AS supp_region, r2.r_name AS cust_region, p_brand, count(*) AS n FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region r1, region r2 WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n2.n_nationkey AND s_nationkey = n1.n_nationkey AND n1.n_regionkey = r1.r_regionkey AND n2.n_regionkey = r2.r_regionkey AND p_size > 25 GROUP BY r1.r_name, r2.r_name, p_brand",
    "join_sixteen": """
SELECT r1.r_name AS cust_region, r2.r_name AS supp_region, r3.r_name AS third, r4.r_name AS fourth, count(*) AS n, min(p2.p_name) AS part_name, max(n5.n_name) AS last_nation
FROM lineitem, orders, customer, supplier s1, part p1, nation n1, nation n2, region r1, region r2, nation n3, region r3, nation n4, region r4, part p2, supplier s2, nation n5
WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s1.s_suppkey AND l_partkey = p1.p_partkey AND c_nationkey = n1.n_nationkey AND s1.s_nationkey = n2.n_nationkey
  AND n1.n_regionkey = r1.r_regionkey AND n2.n_regionkey = r2.r_regionkey AND n3.n_nationkey = p1.p_size % 25 AND n3.n_regionkey = r3.r_regionkey AND n4.n_nationkey = l_linenumber + 10
  AND n4.n_regionkey = r4.r_regionkey AND p2.p_partkey = l_suppkey AND s2.s_suppkey = p1.p_size AND s2.s_nationkey = n5.n_nationkey
GROUP BY r1.r_name, r2.r_name, r3.r_name, r4.r_name""",
    "join_self_alias": "SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1, nation n2 WHERE n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey",
    "join_composite": "SELECT a.l_partkey, a.l_suppkey, count(*) AS pairs FROM lineitem a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_partkey, a.l_suppkey",
    "join_transitive": "SELECT count(*) AS n FROM orders o, lineitem l, lineitem m WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey = m.l_orderkey AND l.l_orderkey = m.l_orderkey AND l.l_linenumber < m.l_linenumber",
    "join_left_condition": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) t GROUP BY c_count",
    "join_left_nulls": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT a.k AS ak, b.k AS bk FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) b ON a.k = b.k",
    "join_using": "SELECT l_orderkey, n FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) a JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) b USING (l_orderkey)",
    "join_lateral": "SELECT n.n_nationkey, t.best FROM nation n, LATERAL (SELECT max(c_acctbal) AS best FROM customer c WHERE c.c_nationkey = n.n_nationkey) t",
    "semi_exists": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '3' MONTH AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    "semi_in_having": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)",
    "semi_in_nested": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) AND l_quantity > 30)",
    "anti_not_exists": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)",
    "anti_not_in": "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#2' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size",
    "semi_anti_residual": "SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name",
    "scalar_correlated": "SELECT cast(sum(" + PRICE + ") AS double) / 7.0 AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)",
    "scalar_minimum": "SELECT s_suppkey, p_partkey, l_extendedprice FROM part, supplier, lineitem, nation, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_extendedprice = (SELECT min(l2.l_extendedprice) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)",
    "scalar_uncorrelated": "SELECT l_suppkey, cast(sum(" + PRICE + ") AS double) AS value FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey GROUP BY l_suppkey HAVING sum(" + PRICE + ") > (SELECT sum(" + PRICE + ") * 0.011 FROM lineitem)",
    "join_on_cast": "SELECT n_name, count(*) AS n FROM nation JOIN (SELECT cast(s_nationkey AS varchar(10)) AS k FROM supplier) s ON n_nationkey = cast(s.k AS int) GROUP BY n_name",
    # TPC-H shapes not named above
    "q6_forecast": "SELECT cast(sum(" + PRICE + " * cast(l_discount AS decimal(15,2))) AS double) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "q10_returned": "SELECT c_custkey, c_name, cast(sum(" + REVENUE + ") AS double) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name",
    "q12_priorities": "SELECT l_returnflag, cast(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS high, cast(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_returnflag",
    "q14_promo": "SELECT 100.00 * cast(sum(CASE WHEN p_type LIKE 'PROMO%' THEN " + REVENUE + " ELSE 0 END) AS double) / cast(sum(" + REVENUE + ") AS double) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'",
    "q20_nested_average": "SELECT s_name FROM supplier, nation WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem a WHERE a.l_quantity > (SELECT 1.5 * avg(b.l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)) AND s_nationkey = n_nationkey",
    "q22_segments": "SELECT code, count(*) AS numcust, cast(sum(cast(c_acctbal AS decimal(15,2))) AS double) AS totacctbal FROM (SELECT substring(c_mktsegment FROM 1 FOR 2) AS code, c_acctbal, c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)) t WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = t.c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000) GROUP BY code",
    # aggregates
    "agg_basic": "SELECT l_returnflag, count(*) AS n, count(l_tax) AS n_tax, min(l_quantity) AS lo, max(l_shipdate) AS last, avg(l_quantity) AS mean_qty, cast(sum(" + PRICE + ") AS double) AS total FROM lineitem GROUP BY l_returnflag",
    "agg_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "agg_conditional": "SELECT o_orderstatus, cast(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS bigint) AS large FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT n_regionkey, count(*) AS n, count(*) FILTER (WHERE n_nationkey > 10) AS n_late FROM nation GROUP BY n_regionkey",
    "agg_ratio": "SELECT cast(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS double) / sum(l_quantity) AS share FROM lineitem",
    "agg_empty_input": "SELECT sum(o_totalprice) AS total, count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_orderkey < 0",
    "agg_many_keys": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber",
    "agg_by_alias": "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM orders GROUP BY size_class",
    "agg_of_agg": "SELECT n_orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) t GROUP BY n_orders",
    "agg_having": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) BETWEEN 5 AND 9 AND sum(value) > 0",
    "agg_order_unaliased": "SELECT event_type, user_id FROM events GROUP BY event_type, user_id ORDER BY count(*) DESC, event_type, user_id LIMIT 20",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_statistics": "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS var, median(user_id) AS med FROM events GROUP BY event_type",
    "agg_decimal_exact": "SELECT o_orderstatus, cast(cast(sum(" + TOTAL + ") AS decimal(38,2)) AS varchar(50)) AS total FROM orders GROUP BY o_orderstatus",
    # windows
    "window_row_number": "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) t WHERE rn <= 2",
    "window_over_aggregate": "SELECT event_type, user_id, n, rk FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rk FROM events GROUP BY event_type, user_id) t WHERE rk <= 3",
    "window_lag": "WITH y AS (SELECT cast(extract(year FROM o_orderdate) AS int) AS yr, count(*) AS n FROM orders GROUP BY 1) SELECT yr, n, n - lag(n) OVER (ORDER BY yr) AS diff FROM y",
    "window_frames": "SELECT event_id, sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3, lead(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt, first_value(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS fst FROM events",
    "window_ranks": "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM customer",
    # order, limit, sets
    "sort_mixed": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey ASC LIMIT 25",
    "sort_ordinal": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "sort_nulls_last": "SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t ORDER BY seg ASC NULLS LAST, c_custkey LIMIT 40",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT 'c' AS t, count(*) AS n FROM customer UNION ALL SELECT 's', count(*) FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t",
    # scalar functions
    "fn_strings": "SELECT c_custkey, substring(c_name FROM 3 FOR 4) AS sub, lower(c_mktsegment) AS low, upper(c_name) AS up, replace(c_name, '#', '_') AS rep, c_name || '-' || cast(c_custkey AS varchar(20)) AS cat, length(c_name) AS len, trim('  x ') AS t FROM customer",
    "fn_dates": "SELECT o_orderkey, cast(extract(year FROM o_orderdate) AS int) AS y, cast(extract(month FROM o_orderdate) AS int) AS m, cast(cast(o_orderdate + INTERVAL '1' MONTH AS date) AS varchar(10)) AS next_month, cast(cast(o_orderdate - INTERVAL '10' DAY AS date) AS varchar(10)) AS before FROM orders",
    "fn_date_trunc": "SELECT cast(date_trunc('hour', ts) AS timestamp) AS h, count(*) AS n FROM events GROUP BY 1",
    "fn_math": "SELECT l_orderkey, l_linenumber, l_quantity % 7 AS m, round(l_tax * 10, 1) AS r, abs(l_quantity - 20) AS a, floor(l_quantity / 3) AS f, ceil(l_quantity / 3) AS c, sqrt(l_quantity) AS s FROM lineitem",
    "fn_try_cast": "SELECT n_nationkey, try_cast(n_name AS int) AS bad, try_cast(cast(n_nationkey AS varchar(10)) AS int) AS good FROM nation",
    "fn_case_coalesce": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS k FROM customer",
    "fn_division_by_zero": "SELECT n_nationkey, n_regionkey / nullif(n_regionkey - 2, 0) AS q FROM nation",
    "values_source": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)",
}

#: Texts that differ: (Spark, DuckDB).
PAIRS: dict[str, tuple[str, str]] = {
    "q1_pricing_summary": ("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, cast(sum(PRICE) AS double) AS sum_base_price, cast(sum(REVENUE) AS double) AS sum_disc_price,
       cast(sum(REVENUE * (1 + cast(l_tax AS decimal(15,2)))) AS double) AS sum_charge, avg(l_quantity) AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus""",) * 2,
    "q7_volume_shipping": ("""
SELECT supp_nation, cust_nation, l_year, cast(sum(volume) AS double) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, cast(extract(year FROM l_shipdate) AS int) AS l_year, REVENUE AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3'))) s
GROUP BY supp_nation, cust_nation, l_year""",) * 2,
    "q8_market_share": ("""
SELECT o_year, cast(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS double) / cast(sum(volume) AS double) AS mkt_share FROM (
  SELECT cast(extract(year FROM o_orderdate) AS int) AS o_year, REVENUE AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND s_nationkey = n2.n_nationkey AND p_size > 10) t GROUP BY o_year""",) * 2,
    "q9_product_profit": ("""
SELECT nation, o_year, cast(sum(amount) AS double) AS sum_profit FROM (
  SELECT n_name AS nation, cast(extract(year FROM o_orderdate) AS int) AS o_year, REVENUE AS amount
  FROM part, supplier, lineitem, orders, nation
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%e%') t GROUP BY nation, o_year""",) * 2,
    "filter_regex_cast": ("SELECT c_custkey FROM customer WHERE c_name RLIKE '^.*[0-9]+$' AND try_cast(substring(c_name, length(c_name)) AS float) <= 4",
                          "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^.*[0-9]+$') AND try_cast(substring(c_name, length(c_name)) AS float) <= 4"),
    "project_star_replace": ("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation", "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation"),
    "agg_strlen": ("SELECT p_type, round(avg(octet_length(p_name)) / 3, 2) AS a FROM part GROUP BY p_type", "SELECT p_type, round(avg(strlen(p_name)) / 3, 2) AS a FROM part GROUP BY p_type"),
    "agg_lists": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_quantile": ("SELECT event_type, percentile(user_id, 0.25) AS q FROM events GROUP BY event_type", "SELECT event_type, quantile_cont(user_id, 0.25) AS q FROM events GROUP BY event_type"),
    "window_qualify": ("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS q FROM events GROUP BY event_type, user_id) t WHERE q <= 2",
                       "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) <= 2"),
    "fn_regexp_replace": (r"SELECT c_custkey, regexp_replace(c_name, '^(.*)([0-9])$', '$2-$1') AS r FROM customer", r"SELECT c_custkey, regexp_replace(c_name, '^(.*)([0-9])$', '\2-\1') AS r FROM customer"),
    "fn_epoch": ("SELECT n_nationkey, cast(date_from_unix_date(n_nationkey * 100) AS string) AS d, cast(timestamp_millis(n_nationkey * 86400000L) AS timestamp_ntz) AS t FROM nation",
                 "SELECT n_nationkey, CAST(CAST(DATE '1970-01-01' + CAST(n_nationkey * 100 AS INT) AS DATE) AS VARCHAR) AS d, make_timestamp(n_nationkey::BIGINT * 86400000000) AS t FROM nation"),
    "fn_json": ("SELECT event_id, cast(get_json_object(props, '$.k') AS int) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "fn_arrays": ("SELECT n_regionkey, size(collect_list(n_nationkey)) AS n, array_max(collect_list(n_nationkey)) AS top FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(len(list(n_nationkey)) AS INT) AS n, list_max(list(n_nationkey)) AS top FROM nation GROUP BY n_regionkey"),
    "fn_maps": ("SELECT n_nationkey, element_at(map('a', n_regionkey, 'b', n_nationkey), 'b') AS v FROM nation", "SELECT n_nationkey, map {'a': n_regionkey, 'b': n_nationkey}['b'] AS v FROM nation"),
    "pivot": ("SELECT * FROM (SELECT l_linestatus, l_returnflag FROM lineitem) PIVOT (count(*) FOR l_returnflag IN ('A' AS a, 'N' AS n, 'R' AS r))", "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_linestatus"),
    "unnest": ("SELECT r_regionkey, x FROM region LATERAL VIEW explode(array(r_regionkey, r_regionkey + 10)) t AS x", "SELECT r_regionkey, unnest([r_regionkey, r_regionkey + 10]) AS x FROM region"),
    "generator_cross": ("SELECT n_nationkey, cast(id AS int) AS copy, n_nationkey + id * 100 AS k FROM nation CROSS JOIN range(3)", "SELECT n_nationkey, CAST(range AS INT) AS copy, n_nationkey + range * 100 AS k FROM nation CROSS JOIN range(3)"),
}


def texts() -> dict[str, tuple[str, str]]:
    out = {k: (v, v) for k, v in SHARED.items()}
    for k, pair in PAIRS.items():
        out[k] = tuple(x.replace("REVENUE", REVENUE).replace("PRICE", PRICE) for x in pair)
    return out
