"""Scans, predicates, joins, aggregation, windows, sorting, set operations, subqueries and full text."""

from lathe.plans.registry import sql

# Scans and projection ---------------------------------------------------------------------------
sql("scan_table", "SELECT * FROM nation")
sql("scan_no_from", "SELECT 1 + 1 AS two, 'x' AS x")
sql("scan_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000), top AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT * FROM top WHERE n > 3")
sql("scan_cte_columns", "WITH c (k, v) AS (SELECT c_custkey, c_acctbal FROM customer) SELECT k, v FROM c WHERE v < 0")
sql("scan_derived_table", "SELECT d.seg, d.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) AS d WHERE d.n > 10")
sql("scan_in_list", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (5, 500, 5000, 7123) AND l_quantity > 3")
sql("scan_range", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-02-01'")
sql("count_star", "SELECT count(*) AS n FROM lineitem")
sql("derived_column_list", "SELECT * AS (k, name, region) FROM nation", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation")
sql("projection_expressions", "SELECT o_orderkey, o_totalprice * 0.1 AS tax, upper(o_orderpriority) AS pri, n.* FROM orders, customer, nation n WHERE o_custkey = c_custkey AND c_nationkey = n.n_nationkey")

# Predicates and expressions -----------------------------------------------------------------------
sql("arith_division", "SELECT o_orderkey, o_orderkey / 7 AS d, o_orderkey / (o_orderkey % 3) AS dz, o_orderkey % 5 AS m, o_orderkey % (o_orderkey % 2) AS mz FROM orders",
    "SELECT o_orderkey, o_orderkey / 7 AS d, o_orderkey / nullif(o_orderkey % 3, 0) AS dz, o_orderkey % 5 AS m, o_orderkey % nullif(o_orderkey % 2, 0) AS mz FROM orders")
sql("arith_div_mod", "SELECT o_orderkey, o_orderkey DIV 7 AS d, MOD(o_orderkey, 4) AS m, - o_orderkey AS neg FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 4 AS m, - o_orderkey AS neg FROM orders")
sql("pred_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 OR p_size NOT BETWEEN 3 AND 48 OR p_size BETWEEN 9 AND 7")
sql("pred_between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 12 AND 10", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12")
sql("pred_in", "SELECT n_name, n_regionkey IN (1, 2, NULL) AS i, n_regionkey NOT IN (1, 2, NULL) AS ni FROM nation")
sql("pred_in_empty", "SELECT n_name FROM nation WHERE n_nationkey NOT IN () AND NOT n_nationkey IN ()", "SELECT n_name FROM nation")
sql("pred_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%M_' OR p_type NOT LIKE 'S%' AND p_brand LIKE 'Brand#_' AND p_brand NOT LIKE '%1'")
sql("pred_null", "SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'F') IS NULL THEN 1 ELSE 0 END AS f, nullif(o_orderstatus, 'F') IS NOT NULL AS nf FROM orders")
sql("pred_three_valued", "SELECT n_nationkey, (nullif(n_regionkey, 1) > 2 AND n_nationkey > 5) AS a, (nullif(n_regionkey, 1) > 2 OR n_nationkey > 5) AS o, NOT (nullif(n_regionkey, 1) > 2) AS n FROM nation")
sql("case_searched", "SELECT l_returnflag, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1, 2")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS s FROM orders")
sql("cast_values", "SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST('12' AS INTEGER) AS n, CAST(o_orderdate AS DATE) AS d FROM orders",
    "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST(12 AS BIGINT) AS n, CAST(o_orderdate AS DATE) AS d FROM orders")
sql("concat_operator", "SELECT c_custkey, c_name || '-' || c_mktsegment AS k FROM customer")
sql("date_interval", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '3' DAY AS DATE) AS d3, CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS m1, CAST(o_orderdate - INTERVAL '2' YEAR AS DATE) AS y2 FROM orders")

# Joins --------------------------------------------------------------------------------------------
sql("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql("join_inner_residual", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice * 0.5 WHERE o_orderstatus = 'P'")
sql("join_where_equi", "SELECT c_mktsegment, count(*) AS n FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_mktsegment")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000 GROUP BY c_custkey")
sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 490000")
sql("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 3")
sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = 1")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y")
sql("join_natural_left", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL LEFT JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier WHERE s_acctbal > 5000) y")
sql("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_parenthesized", "SELECT c_name, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
sql("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
sql("join_or_common_equi", "SELECT count(*) AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size = 3 AND l_quantity > 40) OR (p_partkey = l_partkey AND p_size = 9 AND l_quantity < 5)")

# Subqueries ---------------------------------------------------------------------------------------
sql("subquery_scalar", "SELECT c_custkey, c_acctbal - (SELECT avg(c_acctbal) FROM customer) > 0 AS above FROM customer")
sql("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("subquery_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
sql("subquery_not_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)")
sql("subquery_not_in_null", "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 5)")
sql("subquery_not_in_select", "SELECT n_nationkey, n_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 5) AS v FROM nation")
for _op in (">", ">=", "<", "<=", "=", "<>"):
    _name = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "=": "eq", "<>": "ne"}[_op]
    sql(f"quantified_{_name}_all", f"SELECT p_partkey, p_size {_op} ALL (SELECT n_nationkey + 1 FROM nation WHERE n_regionkey = 2) AS v, p_size {_op} ALL (SELECT nullif(n_nationkey, 4) FROM nation WHERE n_regionkey < 4) AS vn FROM part")
    sql(f"quantified_{_name}_any", f"SELECT p_partkey, p_size {_op} ANY (SELECT n_nationkey + 1 FROM nation WHERE n_regionkey = 2) AS v, p_size {_op} SOME (SELECT nullif(n_nationkey, 4) FROM nation WHERE n_regionkey < 4) AS vn FROM part",
        f"SELECT p_partkey, p_size {_op} ANY (SELECT n_nationkey + 1 FROM nation WHERE n_regionkey = 2) AS v, p_size {_op} ANY (SELECT nullif(n_nationkey, 4) FROM nation WHERE n_regionkey < 4) AS vn FROM part")
sql("quantified_all_empty", "SELECT n_nationkey FROM nation WHERE n_nationkey > ALL (SELECT n_nationkey FROM nation WHERE n_nationkey > 100) AND NOT n_nationkey > ANY (SELECT n_nationkey FROM nation WHERE n_nationkey > 100)")

# Aggregation --------------------------------------------------------------------------------------
sql("agg_global", "SELECT count(*) AS n, sum(l_linenumber) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_returnflag) AS hi FROM lineitem",
    "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_returnflag) AS hi FROM lineitem")
sql("agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo FROM lineitem WHERE l_orderkey < 0")
sql("agg_no_from", "SELECT count(*) AS n")
sql("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_group_null", "SELECT nullif(n_regionkey, 2) AS r, count(*) AS n, count(nullif(n_regionkey, 2)) AS c FROM nation GROUP BY nullif(n_regionkey, 2)")
sql("agg_distinct", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segs, count(ALL c_mktsegment) AS n FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segs, count(c_mktsegment) AS n FROM customer GROUP BY c_nationkey")
sql("agg_distinct_sum", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s, round(avg(DISTINCT l_quantity), 6) AS a, min(DISTINCT l_quantity) AS lo, max(DISTINCT l_quantity) AS hi FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
sql("agg_having_subquery", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT avg(t) * 1.5 FROM (SELECT sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) AS x)")
sql("agg_expressions", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS mean, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size, round(max(o_totalprice) - min(o_totalprice), 2) AS span FROM orders GROUP BY o_orderstatus")

# Windows ------------------------------------------------------------------------------------------
sql("window_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer")
sql("window_rank_unordered", "SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey) AS r, dense_rank() OVER () AS d FROM nation", "SELECT n_nationkey, CAST(1 AS INT) AS r, CAST(1 AS INT) AS d FROM nation")
sql("window_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer")
sql("window_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next2 FROM orders")
sql("window_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders",
    "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql("window_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS run, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS run, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
sql("window_frames", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS a, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM orders")
sql("window_whole", "SELECT c_custkey, round(c_acctbal / nullif(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 0), 8) AS share, count(*) OVER () AS n, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo FROM customer")
sql("window_sum_double", "SELECT n_nationkey, sum(n_regionkey) OVER (PARTITION BY n_regionkey) AS s FROM nation", "SELECT n_nationkey, CAST(sum(n_regionkey) OVER (PARTITION BY n_regionkey) AS DOUBLE) AS s FROM nation")
sql("window_in_order_by", "SELECT n_name FROM nation ORDER BY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name), n_name LIMIT 7")

# Sorting, limits, distinct, set operations --------------------------------------------------------
sql("sort_nulls_last", "SELECT nullif(n_regionkey, 2) AS r, n_nationkey FROM nation ORDER BY r, n_nationkey LIMIT 22", "SELECT nullif(n_regionkey, 2) AS r, n_nationkey FROM nation ORDER BY r NULLS LAST, n_nationkey LIMIT 22")
sql("sort_nulls_last_desc", "SELECT nullif(n_regionkey, 2) AS r, n_nationkey FROM nation ORDER BY r DESC, n_nationkey LIMIT 22", "SELECT nullif(n_regionkey, 2) AS r, n_nationkey FROM nation ORDER BY r DESC NULLS LAST, n_nationkey LIMIT 22")
sql("sort_position", "SELECT c_nationkey, c_custkey FROM customer ORDER BY 1 DESC, 2 LIMIT 9")
sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
sql("topk", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
sql("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
sql("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("set_union", "SELECT nullif(n_regionkey, 1) AS k FROM nation UNION SELECT r_regionkey FROM region")
sql("set_intersect", "SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 1")
sql("set_intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_nationkey % 3 FROM nation")
sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
sql("set_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
sql("set_left_associative", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 4 UNION SELECT r_regionkey FROM region INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2 ORDER BY 1",
    "(SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 4 UNION SELECT r_regionkey FROM region) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2 ORDER BY 1")

# Full text ----------------------------------------------------------------------------------------
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}*]+'), lambda w: strlen(w) >= 3)"
sql("fulltext_natural", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST ('license thorough stupid')", f"SELECT doc_id FROM documents WHERE list_has_any({_WORDS}, ['license', 'thorough', 'stupid'])")
sql("fulltext_boolean", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST ('+license -apache \"general public\"' IN BOOLEAN MODE)", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND NOT contains(lower(text), 'apache')")
sql("fulltext_boolean_optional", """SELECT doc_id FROM documents WHERE MATCH(text) AGAINST ('"public license" apache -stupid' IN BOOLEAN MODE)""", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'public license') OR contains(lower(text), 'apache')) AND NOT contains(lower(text), 'stupid')")
sql("fulltext_expansion", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST ('moron clown' WITH QUERY EXPANSION)", f"SELECT doc_id FROM documents WHERE list_has_any({_WORDS}, ['moron', 'clown'])")
