"""Scalar functions: one query per family, on the tables at hand."""

from lathe.plans.registry import sql

sql("fn_null", "SELECT o_orderkey, COALESCE(nullif(o_orderstatus, 'F'), 'x') AS c, NULLIF(o_orderkey, 3) AS n, IF(o_orderkey > 100, 'a', 'b') AS i, GREATEST(o_orderkey, 50, NULL) AS g, LEAST(o_orderkey, 50, NULL) AS l FROM orders",
    "SELECT o_orderkey, COALESCE(nullif(o_orderstatus, 'F'), 'x') AS c, NULLIF(o_orderkey, 3) AS n, CASE WHEN o_orderkey > 100 THEN 'a' ELSE 'b' END AS i, GREATEST(o_orderkey, 50, NULL) AS g, LEAST(o_orderkey, 50, NULL) AS l FROM orders")
sql("fn_case", "SELECT doc_id, UPPER(lang) AS u, LOWER(upper(lang)) AS l, REVERSE(source) AS r, REPLACE(source, 'src', 's-') AS p FROM documents")
sql("fn_substring", "SELECT c_custkey, SUBSTRING(c_name, 3, 5) AS a, SUBSTR(c_name, 0, 3) AS z, SUBSTRING(c_name FROM 4 FOR 2) AS f, SUBSTRING(c_name, 2) AS t, SUBSTRING(c_name, -2, 3) AS n, SUBSTRING(c_name, 2, -1) AS e, LEFT(c_name, 4) AS l, RIGHT(c_name, 3) AS r FROM customer",
    "SELECT c_custkey, SUBSTRING(c_name, 3, 5) AS a, SUBSTR(c_name, 1, 3) AS z, SUBSTRING(c_name, 4, 2) AS f, SUBSTRING(c_name, 2) AS t, SUBSTRING(c_name, 1, 3) AS n, '' AS e, LEFT(c_name, 4) AS l, RIGHT(c_name, 3) AS r FROM customer")
sql("fn_length", "SELECT doc_id, CHAR_LENGTH(text) AS c, CHARACTER_LENGTH(text USING OCTETS) AS b, OCTET_LENGTH(text) AS o, LENGTH(text) AS l FROM documents",
    "SELECT doc_id, CAST(length(text) AS INT) AS c, CAST(strlen(text) AS INT) AS b, CAST(strlen(text) AS INT) AS o, CAST(strlen(text) AS INT) AS l FROM documents")
sql("fn_search", "SELECT c_custkey, POSITION('1' IN c_name) AS p, INSTR(c_name, '2') AS i, LOCATE('0', c_name, 0) AS l, LOCATE('0', c_name, 12) AS m, CONCAT(c_name, '/', NULL) AS n, CONCAT(c_name, '/') AS c FROM customer",
    "SELECT c_custkey, CAST(position('1' IN c_name) AS INT) AS p, CAST(instr(c_name, '2') AS INT) AS i, CAST(instr(c_name, '0') AS INT) AS l, CAST(CASE WHEN instr(substring(c_name, 12), '0') = 0 THEN 0 ELSE instr(substring(c_name, 12), '0') + 11 END AS INT) AS m, CAST(NULL AS VARCHAR) AS n, c_name || '/' AS c FROM customer")
sql("fn_trim", "SELECT n_nationkey, TRIM('  a b ') AS t, TRIM(LEADING 'x' FROM 'xxaxx') AS l, TRIM(TRAILING 'x' FROM 'xxaxx') AS r, TRIM(BOTH 'ab' FROM 'ababcab') AS w, TRIM('N' FROM n_name) AS c FROM nation",
    "SELECT n_nationkey, 'a b' AS t, 'axx' AS l, 'xxa' AS r, 'c' AS w, trim(n_name, 'N') AS c FROM nation")
sql("fn_numeric", "SELECT l_orderkey, l_linenumber, ABS(-l_quantity) AS a, SIGN(l_discount - 0.05) AS s, ROUND(l_extendedprice, 1) AS r, TRUNCATE(l_extendedprice / 7, 1) AS t, FLOOR(l_tax * 10) AS f, CEIL(l_tax * 10) AS c, POWER(l_linenumber, 2) AS p, SQRT(l_quantity) AS q, PI() AS pi FROM lineitem",
    "SELECT l_orderkey, l_linenumber, ABS(-l_quantity) AS a, CAST(SIGN(l_discount - 0.05::DOUBLE) AS INT) AS s, ROUND(l_extendedprice, 1) AS r, trunc(l_extendedprice / 7 * 10) / 10 AS t, FLOOR(l_tax * 10) AS f, CEIL(l_tax * 10) AS c, POWER(l_linenumber, 2) AS p, SQRT(l_quantity) AS q, PI() AS pi FROM lineitem")
sql("fn_logarithms", "SELECT p_partkey, ROUND(EXP(p_size / 10), 6) AS e, ROUND(LN(p_size), 9) AS n, ROUND(LOG(p_size), 9) AS g, ROUND(LOG10(p_size), 9) AS t FROM part",
    "SELECT p_partkey, ROUND(EXP(p_size / 10), 6) AS e, ROUND(LN(p_size), 9) AS n, ROUND(LN(p_size), 9) AS g, ROUND(LOG10(p_size), 9) AS t FROM part")
sql("fn_trigonometry", "SELECT p_partkey, ROUND(SIN(p_size), 9) AS s, ROUND(COS(p_size), 9) AS c, ROUND(TAN(p_size), 6) AS t, ROUND(ASIN(p_size / 50), 9) AS a, ROUND(ACOS(p_size / 50), 9) AS o, ROUND(ATAN(p_size), 9) AS n, ROUND(ATAN2(p_size, 3), 9) AS n2, ROUND(RADIANS(p_size), 9) AS r, ROUND(DEGREES(p_size), 6) AS d FROM part")
sql("fn_format", "SELECT o_orderkey, FORMAT(o_totalprice, 2) AS f, FORMAT(o_totalprice, -1) AS g FROM orders",
    "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS f, format('{:,.0f}', round_even(o_totalprice, 0)) AS g FROM orders")
sql("fn_date_parts", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, EXTRACT('YEAR', o_orderdate) AS ey, EXTRACT(MONTH FROM o_orderdate) AS em, DATEDIFF(o_orderdate, DATE '1995-01-01') AS dd FROM orders",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(year(o_orderdate) AS INT) AS ey, CAST(month(o_orderdate) AS INT) AS em, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS dd FROM orders")
sql("fn_time_parts", "SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s FROM events",
    "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s FROM events")
sql("fn_date_add", "SELECT o_orderkey, DATE_ADD(CAST(o_orderdate AS DATE), 3, 'DAY') AS d, DATE_ADD(CAST(o_orderdate AS DATE), 1, 'MONTH') AS m, DATE_SUB(CAST(o_orderdate AS DATE), 2, 'YEAR') AS y, ADDDATE(CAST(o_orderdate AS DATE), INTERVAL '1' DAY) AS i FROM orders",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 YEAR AS DATE) AS y, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS i FROM orders")
sql("fn_age", "SELECT n_nationkey, AGE(DATE '2024-03-15', DATE '2022-01-20') AS a, AGE(DATE '2020-01-01', DATE '2020-01-01') AS z, AGE(DATE '2020-01-10', DATE '2020-03-25') AS n FROM nation",
    "SELECT n_nationkey, '2 years 1 month 24 days' AS a, '0 days' AS z, '-2 months 15 days' AS n FROM nation")
sql("fn_to_char", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'YYYY-MM-DD') AS d, TO_CHAR(o_orderdate, 'DD/MM/YY HH24:MI') AS s, TO_CHAR(o_totalprice, '999,999.99') AS n, TO_CHAR(0.25, '99.9%') AS p, TO_CHAR(-5, '$9.00') AS m FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%d/%m/%y %H:%M') AS s, format('{:,.2f}', o_totalprice) AS n, '25.0%' AS p, '-$5.00' AS m FROM orders")
sql("fn_parse", "SELECT n_nationkey, TO_NUMBER('1,234.5') AS n, TO_DATE('15/03/2024', 'DD/MM/YYYY') AS d, TO_TIMESTAMP('2024-03-15 10:20:30', 'YYYY-MM-DD HH24:MI:SS') AS t, CAST('7', 'INTEGER') AS c FROM nation",
    "SELECT n_nationkey, 1234.5::DOUBLE AS n, DATE '2024-03-15' AS d, TIMESTAMP '2024-03-15 10:20:30' AS t, CAST(7 AS BIGINT) AS c FROM nation")
sql("fn_session", "SELECT count(*) AS n FROM nation WHERE VERSION() IS NOT NULL AND DATABASE() IS NOT NULL AND USER() IS NOT NULL AND CURRENT_DATE >= DATE '2020-01-01' AND CURDATE() = CURRENT_DATE AND NOW() > TIMESTAMP '2020-01-01 00:00:00'",
    "SELECT count(*) AS n FROM nation")
