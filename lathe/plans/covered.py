"""Queries for the rest of the operators: joins, masks, geometry, constraints, definitions, files. Refusals are rows too."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lathe.engine import Engine
from lathe.functions import spatial
from lathe.lexer import SqlError
from lathe.plans.registry import add, sql
from lathe.plans.stateful import _ALL, _BASE, _NATIONS, _SQ, _spatial, script
from lathe.session import register, shared_dir
from lathe.sources import dump, files

# Joins, grouping, windows, subqueries ---------------------------------------------------------------
_X, _Y = "(SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15)", "(SELECT s_nationkey AS k, s_name AS b FROM supplier WHERE s_acctbal > 3000)"
sql("join_natural_right", f"SELECT k, a, b FROM {_X} x NATURAL RIGHT JOIN {_Y} y")
sql("join_natural_full", f"SELECT k, a, b FROM {_X} x NATURAL FULL JOIN {_Y} y")
sql("agg_group_alias", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY s, p")
sql("agg_wildcard", "SELECT count(*) AS n, t.* FROM (SELECT c_nationkey, c_mktsegment FROM customer) t GROUP BY c_nationkey, c_mktsegment")
sql("window_range", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n, min(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo FROM customer")
sql("subquery_cte", "SELECT c_custkey FROM customer WHERE c_nationkey IN (WITH far AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) SELECT n_nationkey FROM far) AND c_acctbal > (WITH m AS (SELECT avg(c_acctbal) AS a FROM customer) SELECT a FROM m)")
sql("column_naming", "SELECT n_nationkey + 1 AS next, n_name, nation.n_regionkey, upper(n_name) AS `Upper_Name` FROM nation", "SELECT n_nationkey + 1 AS next, n_name, n_regionkey, upper(n_name) AS Upper_Name FROM nation")
sql("case_operand", "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN 1 ELSE 2 END > ALL (SELECT r_regionkey FROM region WHERE r_regionkey < 2) AS g, CASE n_regionkey WHEN 1 THEN 3 ELSE 9 END NOT IN (SELECT r_regionkey FROM region) AS o FROM nation")
sql("fulltext_stopwords", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST ('the and of about license')", "SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}*]+'), 'license')")
sql("fulltext_null", "SELECT n_nationkey FROM nation WHERE MATCH(n_name) AGAINST (NULL) OR (MATCH(n_name) AGAINST ('') AND n_nationkey < 4)", "SELECT n_nationkey FROM nation WHERE n_nationkey < 4")

# Functions ----------------------------------------------------------------------------------------
sql("fn_to_char_months", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'DD Mon YYYY') AS a, TO_CHAR(o_orderdate, 'Month') AS b, TO_CHAR(o_orderdate, 'Dy') AS c, TO_CHAR(o_orderdate, 'Day') AS d FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS a, strftime(o_orderdate, '%B') AS b, strftime(o_orderdate, '%a') AS c, strftime(o_orderdate, '%A') AS d FROM orders")
sql("fn_to_char_hours", "SELECT event_id, TO_CHAR(ts, 'HH12:MI:SS AM') AS a, TO_CHAR(ts, 'HH24:MI') AS b, TO_CHAR(ts, 'HH12 pm') AS c FROM events",
    "SELECT event_id, strftime(ts, '%I:%M:%S %p') AS a, strftime(ts, '%H:%M') AS b, strftime(ts, '%I ') || lower(strftime(ts, '%p')) AS c FROM events")
sql("fn_clock", "SELECT count(*) AS n FROM nation WHERE CURRENT_TIME IS NOT NULL AND CURTIME() IS NOT NULL AND CURRENT_TIMESTAMP > TIMESTAMP '2020-01-01 00:00:00' AND DATETIME('now') > TIMESTAMP '2020-01-01 00:00:00' AND DATETIME('2024-03-15 10:20:30') = TIMESTAMP '2024-03-15 10:20:30'",
    "SELECT count(*) AS n FROM nation")

# Geometry -----------------------------------------------------------------------------------------
_P = "concat('POINT(', n_nationkey, ' ', n_regionkey, ')')"
_L = "concat('LINESTRING(0 0, ', n_nationkey, ' ', n_regionkey, ')')"
_B = "concat('POLYGON((', n_nationkey, ' 0, ', n_nationkey + 4, ' 0, ', n_nationkey + 4, ' 2, ', n_nationkey, ' 2, ', n_nationkey, ' 0))')"
_spatial("spatial_from_text", f"SELECT n_nationkey, ST_X(ST_PointFromText({_P})) AS x, ST_Length(ST_LineFromText({_L})) AS l, ST_Area(ST_PolygonFromText({_B})) AS a, ST_Y(ST_GeomFromText({_P})) AS y FROM nation",
         "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS x, sqrt(power(n_nationkey, 2) + power(n_regionkey, 2)) AS l, 8.0::DOUBLE AS a, CAST(n_regionkey AS DOUBLE) AS y FROM nation")
_spatial("spatial_wkb", f"SELECT n_nationkey, ST_AsBinary('POINT(1 2)') AS b, ST_X(ST_PointFromWKB(ST_AsBinary({_P}))) AS x, ST_Length(ST_LineFromWKB(ST_AsBinary({_L}))) AS l, ST_Area(ST_PolygonFromWKB(ST_AsBinary({_B}))) AS a, ST_Y(ST_GeomFromWKB(ST_AsBinary({_P}))) AS y FROM nation",
         "SELECT n_nationkey, '0x0101000000000000000000F03F0000000000000040' AS b, CAST(n_nationkey AS DOUBLE) AS x, sqrt(power(n_nationkey, 2) + power(n_regionkey, 2)) AS l, 8.0::DOUBLE AS a, CAST(n_regionkey AS DOUBLE) AS y FROM nation")
_spatial("spatial_attributes", f"SELECT n_nationkey, ST_GeometryType({_L}) AS t, ST_Dimension({_P}) AS d0, ST_Dimension({_L}) AS d1, ST_Dimension({_B}) AS d2, ST_SRID(ST_SetSRID({_P}, 4326)) AS s, ST_SRID({_P}) AS s0, ST_AsGeoJSON({_P}) AS j FROM nation",
         "SELECT n_nationkey, 'LINESTRING' AS t, 0 AS d0, 1 AS d1, 2 AS d2, 4326 AS s, 0 AS s0, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',' || n_regionkey || ']}' AS j FROM nation")
_spatial("spatial_relations", f"SELECT n_nationkey, ST_Within({_P}, {_SQ}) AS w, ST_Covers({_SQ}, {_P}) AS c, ST_CoveredBy({_P}, {_SQ}) AS cb, ST_Equals({_P}, 'POINT(3 1)') AS e, ST_Overlaps({_SQ}, {_B}) AS o, ST_Crosses('LINESTRING(-1 1, 100 1)', {_B}) AS x FROM nation",
         "SELECT n_nationkey, n_nationkey > 2 AND n_nationkey < 12 AND n_regionkey = 2 AS w, n_nationkey BETWEEN 2 AND 12 AND n_regionkey BETWEEN 1 AND 3 AS c, n_nationkey BETWEEN 2 AND 12 AND n_regionkey BETWEEN 1 AND 3 AS cb, n_nationkey = 3 AND n_regionkey = 1 AS e, n_nationkey < 12 AS o, true AS x FROM nation")
_spatial("spatial_shapes", f"SELECT n_nationkey, ST_Area(ST_Envelope({_L})) AS e, ST_Area(ST_ConvexHull('LINESTRING(0 0, 4 0, 4 3, 1 1)')) AS h, ST_Contains({_B}, ST_PointOnSurface({_B})) AS p, ST_Length(ST_Boundary({_B})) AS b, ST_HausdorffDistance('POINT(0 0)', {_P}) AS d, ST_AsText(ST_Simplify('LINESTRING(0 0, 1 0.01, 2 0)', 0.5)) AS s FROM nation",
         "SELECT n_nationkey, CAST(n_nationkey * n_regionkey AS DOUBLE) AS e, 6.5::DOUBLE AS h, true AS p, 12.0::DOUBLE AS b, sqrt(power(n_nationkey, 2) + power(n_regionkey, 2)) AS d, 'LINESTRING(0 0, 2 0)' AS s FROM nation")
_spatial("spatial_symdifference", f"SELECT n_nationkey, ST_Area(ST_SymDifference({_SQ}, 'POLYGON((0 0, 4 0, 4 2, 0 2, 0 0))')) AS s FROM nation", "SELECT n_nationkey, 24.0::DOUBLE AS s FROM nation")


# Refusals -----------------------------------------------------------------------------------------
def refused(name: str, source: str, statements: list[str], result: str, oracle: str, before: Callable[[Engine], None] | None = None) -> None:
    """Statements that have to fail, then a query: k, kind of the error (null if there was none), and the query's number n."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        engine, own = Engine(spark), uuid.uuid4().hex[:8]
        named = lambda text: text.replace("{a}", f"a_{own}").replace("{b}", f"b_{own}").replace("{v}", f"v_{own}")
        engine.sql(named(source))
        if before:
            before(engine)
        kinds: list[str | None] = []
        for s in statements:
            try:
                engine.sql(named(s))
                kinds.append(None)
            except (SqlError, AnalysisException) as e:
                kinds.append(type(e).__name__)
        n = engine.sql(named(result)).first()[0]
        return spark.createDataFrame([(k, kind, n) for k, kind in enumerate(kinds)], "k int, kind string, n long")

    add(name, run, oracle)


def _kinds(kinds: list[str | None], n: str) -> str:
    each = " UNION ALL ".join(f"SELECT {k} AS k, {'NULL' if v is None else repr(v)} AS kind" for k, v in enumerate(kinds))
    return f"SELECT k, CAST(kind AS VARCHAR) AS kind, CAST(({n}) AS BIGINT) AS n FROM ({each})"


_C = "ConstraintError"
_COUNT, _OLD = "SELECT count(*) FROM {a}", "SELECT count(*) FROM nation"
refused("constraint_not_null", _NATIONS, ["INSERT INTO {a} VALUES (100, NULL, 1)", "UPDATE {a} SET name = NULL WHERE k = 1", "INSERT INTO {a} (k) VALUES (100)"], _COUNT, _kinds([_C] * 3, _OLD))
refused("constraint_primary_key", _NATIONS, ["INSERT INTO {a} VALUES (1, 'again', 1)", "INSERT INTO {a} VALUES (NULL, 'none', 1)", "UPDATE {a} SET k = 5 WHERE k = 6", "INSERT INTO {a} VALUES (100, 'x', 1), (100, 'y', 1)"], _COUNT, _kinds([_C] * 4, _OLD))
refused("constraint_unique", "CREATE TABLE {a} (k INTEGER PRIMARY KEY, name VARCHAR(30) UNIQUE, r INTEGER, UNIQUE (r, k)); INSERT INTO {a} SELECT n_nationkey, n_name, n_regionkey FROM nation; INSERT INTO {a} VALUES (101, NULL, 1), (102, NULL, 1)", ["INSERT INTO {a} VALUES (100, 'NATION_3', 1)", "UPDATE {a} SET name = 'NATION_3' WHERE k = 4"], _COUNT, _kinds([_C] * 2, "SELECT count(*) + 2 FROM nation"))
refused("constraint_check", "CREATE TABLE {a} (k INTEGER CHECK (k >= 0), r INTEGER, CONSTRAINT small CHECK (r < 10 OR r = k)); INSERT INTO {a} SELECT n_nationkey, n_regionkey FROM nation", ["INSERT INTO {a} VALUES (-1, 1)", "INSERT INTO {a} VALUES (1, 11)", "UPDATE {a} SET r = 50", "INSERT INTO {a} VALUES (NULL, NULL)"], _COUNT, _kinds([_C, _C, _C, None], "SELECT count(*) + 1 FROM nation"))
_FAMILY = "CREATE TABLE {a} (k INTEGER PRIMARY KEY); INSERT INTO {a} SELECT r_regionkey FROM region; CREATE TABLE {b} (n INTEGER PRIMARY KEY, k INTEGER DEFAULT 0 REFERENCES {a}(k) %s); INSERT INTO {b} SELECT n_nationkey, n_regionkey FROM nation;"
refused("constraint_foreign_key", _FAMILY % "", ["INSERT INTO {b} VALUES (100, 77)", "UPDATE {b} SET k = 77 WHERE n = 1", "DELETE FROM {a} WHERE k = 1", "INSERT INTO {b} VALUES (100, NULL)", "INSERT INTO {b} VALUES (101, 2)"], "SELECT count(*) FROM {b}", _kinds([_C, _C, _C, None, None], "SELECT count(*) + 2 FROM nation"))
refused("fk_update_restrict", _FAMILY % "ON UPDATE RESTRICT", ["UPDATE {a} SET k = 50 WHERE k = 3", "UPDATE {a} SET k = k"], "SELECT sum(k) FROM {b}", _kinds([_C, None], "SELECT sum(n_regionkey) FROM nation"))
refused("set_column_count", _NATIONS, ["SELECT k FROM {a} UNION SELECT k, r FROM {a}", "INSERT INTO {a} VALUES (1)"], _COUNT, _kinds(["AnalysisException", "SqlError"], _OLD))
refused("view_dependents", _NATIONS + "CREATE VIEW {v} AS SELECT k FROM {a};", ["DROP TABLE {a}", "DROP TABLE {a} CASCADE", "SELECT * FROM {v}"], "SELECT count(*) FROM nation", _kinds(["SqlError", None, "AnalysisException"], _OLD))
refused("ddl_drop", _NATIONS, ["DROP TABLE IF EXISTS {b}", "DROP TABLE {b}", "DROP TABLE {a}", "CREATE TABLE {a} (k INTEGER)", "CREATE TABLE {a} (k INTEGER)", "CREATE TABLE IF NOT EXISTS {a} (k INTEGER)"], _COUNT, _kinds([None, "SqlError", None, None, "SqlError", None], "SELECT 0"))
refused("privileges", _NATIONS + "CREATE ROLE {v}; GRANT SELECT, INSERT ON {a} TO {v}; REVOKE INSERT ON {a} FROM {v}; SET ROLE {v};", ["SELECT * FROM {a}", "INSERT INTO {a} VALUES (100, 'x', 1)", "DELETE FROM {a}"], _COUNT, _kinds([None, "PrivilegeError", "PrivilegeError"], _OLD), lambda e: setattr(e, "secure", True))
refused("domain_checks", "CREATE DOMAIN {v} AS INTEGER DEFAULT 5 CHECK (VALUE > 0); CREATE TABLE {a} (k INTEGER, d {v}); INSERT INTO {a} SELECT n_nationkey, n_nationkey + 1 FROM nation; INSERT INTO {a} (k) VALUES (100);", ["INSERT INTO {a} VALUES (101, 0)", "INSERT INTO {a} VALUES (102, 3)", "UPDATE {a} SET d = -d"], "SELECT sum(d) FROM {a}", _kinds([_C, None, _C], "SELECT sum(n_nationkey + 1) + 8 FROM nation"))

# Changes and definitions ----------------------------------------------------------------------------
script("dml_auto_increment", "CREATE TABLE {a} (k INTEGER AUTO_INCREMENT PRIMARY KEY, name VARCHAR(30));", "INSERT INTO {a} (name) SELECT n_name FROM nation ORDER BY n_nationkey; INSERT INTO {a} (name) VALUES ('last')", "SELECT min(k) AS lo, max(k) AS hi, count(DISTINCT k) AS n, max(CASE WHEN name = 'last' THEN k END) AS last FROM {a}", "SELECT CAST(1 AS BIGINT) AS lo, count(*) + 1 AS hi, count(*) + 1 AS n, count(*) + 1 AS last FROM nation")
_KIDS = "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(%s AS BIGINT) AS k FROM nation"
script("fk_update_set_null", _FAMILY % "ON UPDATE SET NULL", "UPDATE {a} SET k = 50 WHERE k = 3", "SELECT n, k FROM {b}", _KIDS % "nullif(n_regionkey, 3)")
script("fk_update_set_default", _FAMILY % "ON UPDATE SET DEFAULT", "UPDATE {a} SET k = 50 WHERE k = 3", "SELECT n, k FROM {b}", _KIDS % "CASE WHEN n_regionkey = 3 THEN 0 ELSE n_regionkey END")
script("ddl_analyze", _NATIONS, "ANALYZE {a}", _ALL, _BASE)
script("ddl_schema", "", "CREATE SCHEMA IF NOT EXISTS s_{a}; SET SCHEMA s_{a}; SET NAMES 'UTF8'; SET TIME ZONE LOCAL; SET SCHEMA default; DROP SCHEMA s_{a}", "SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM nation")
script("session_variable", "", "SET @x = 7; SET @y = @x * 2", "SELECT n_nationkey, @x AS x, @y + n_nationkey AS y FROM nation", "SELECT n_nationkey, 7 AS x, 14 + n_nationkey AS y FROM nation")
script("select_into_variable", _NATIONS, "SELECT max(k), min(name) INTO @hi, @lo FROM {a}", "SELECT @hi AS hi, @lo AS lo", "SELECT CAST(max(n_nationkey) AS INT) AS hi, min(n_name) AS lo FROM nation")


def _shown(name: str, statements: list[str], columns: list[str], oracle: str) -> None:
    """Rows of SHOW and DESCRIBE statements under other names; {a} in them is put back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        engine, own = Engine(spark), f"a_{uuid.uuid4().hex[:8]}"
        engine.sql(_NATIONS.replace("{a}", own))
        engine.sql(f"CREATE INDEX i_{own} ON {own} (r, name)")
        rows = [tuple(v.replace(own, "a") if isinstance(v, str) else v for v in r) for s in statements for r in engine.sql(s.replace("{a}", own)).collect()]
        return spark.createDataFrame(rows, ", ".join(columns))

    add(name, run, oracle)


_shown("show_columns", ["DESCRIBE {a}"], ["name string", "kind string", "nullable boolean", "preset string"], "SELECT * FROM (VALUES ('k', 'bigint', false, NULL), ('name', 'string', false, NULL), ('r', 'bigint', true, '7')) AS t(name, kind, nullable, preset)")
_shown("show_index", ["SHOW INDEX FROM {a}"], ["name string", "tab string", "cols string", "kind string"], "SELECT 'i_a' AS name, 'a' AS tab, 'r,name' AS cols, '' AS kind")
_shown("show_tables", ["SHOW TABLES"], ["tab string"], "SELECT 'a' AS tab")
script("objects", "", "CREATE TYPE t_{a} AS INTEGER; CREATE SEQUENCE q_{a} START WITH 5; ALTER SEQUENCE q_{a} INCREMENT BY 2; CREATE COLLATION c_{a} FOR UTF8; CREATE TABLE {a} (k t_{a}); INSERT INTO {a} SELECT n_nationkey FROM nation; DROP SEQUENCE q_{a}; DROP COLLATION c_{a}", "SELECT k FROM {a}", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation")


script("trigger_row_update", _NATIONS, "CREATE TABLE {b} (r INTEGER PRIMARY KEY, n INTEGER); INSERT INTO {b} SELECT r_regionkey, 0 FROM region; CREATE TRIGGER t AFTER UPDATE ON {a} FOR EACH ROW WHEN (NEW.k < 8) UPDATE {b} SET n = n + NEW.k - OLD.r WHERE r = NEW.r; UPDATE {a} SET name = 'x' WHERE k < 12",
       "SELECT r, n FROM {b}", "SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(coalesce((SELECT sum(n_nationkey - n_regionkey) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 8), 0) AS BIGINT) AS n FROM region")
script("trigger_row_delete", _NATIONS, "CREATE TABLE {b} (k INTEGER, r INTEGER); INSERT INTO {b} SELECT n_nationkey, n_regionkey FROM nation; CREATE TRIGGER t AFTER DELETE ON {a} FOR EACH ROW DELETE FROM {b} WHERE k = OLD.k + 1; DELETE FROM {a} WHERE k IN (3, 9)",
       "SELECT k FROM {b}", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey NOT IN (4, 10)")
script("routine_function_if", "", "CREATE FUNCTION f_{a}(x INTEGER, y INTEGER) RETURNS INTEGER BEGIN DECLARE z INTEGER DEFAULT 3; IF x > 20 THEN RETURN -1; ELSEIF x > 10 THEN SET z = 4; IF y = 2 THEN SET z = z * 10; END IF; ELSE SET y = y + 1; END IF; RETURN x * z + y; END", "SELECT n_nationkey AS k, f_{a}(n_nationkey, n_regionkey) AS v FROM nation",
       "SELECT n_nationkey AS k, CAST(CASE WHEN n_nationkey > 20 THEN -1 WHEN n_nationkey > 10 THEN n_nationkey * (CASE WHEN n_regionkey = 2 THEN 40 ELSE 4 END) + n_regionkey ELSE n_nationkey * 3 + n_regionkey + 1 END AS BIGINT) AS v FROM nation")


# Files --------------------------------------------------------------------------------------------
def _round_trip(name: str, there: Callable[[DataFrame, str], None], back: Callable[[SparkSession, str, str], DataFrame]) -> None:
    """Rows written to the shared folder and read again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, "customer")
        rows = spark.table("customer")
        path = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
        there(rows, path)
        return back(spark, path, rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")).select(*rows.columns)

    add(name, run, "SELECT * FROM customer")


_round_trip("file_csv", files.write_csv, files.read_csv)
_round_trip("file_json", files.write_json, files.read_json)
_round_trip("file_binary", files.write_parquet, lambda spark, path, schema: spark.read.schema(schema).parquet(path))
_round_trip("file_binary_plain", lambda rows, path: files.write_parquet(rows, path, compressed=False), lambda spark, path, schema: spark.read.schema(schema).parquet(path))


def _database(name: str, save: Callable, load: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        path, own = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}", f"a_{uuid.uuid4().hex[:8]}"
        first = Engine(spark)
        first.sql(_NATIONS.replace("{a}", own))
        save(first, path)
        first.sql(f"DROP TABLE {own}")
        second = Engine(spark)
        load(second, path)
        second.sql(f"INSERT INTO {own} (k, name) VALUES (100, 'after')")
        return second.sql(_ALL.replace("{a}", own))

    add(name, run, f"{_BASE} UNION ALL VALUES (100, 'after', 7)")


_database("file_dump", dump.save, dump.load)
_database("file_json_database", dump.save_json, dump.load)


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "region")
    rows = spark.table("region").orderBy("r_regionkey")
    return spark.createDataFrame([(f, files.render(rows, f)) for f in ("csv", "json", "markdown", "html", "table")], "form string, result string")


add("file_result_formats", _rendered, """
WITH r AS (SELECT * FROM region ORDER BY r_regionkey), w AS (SELECT greatest(max(length(r_name)), 6) AS n FROM r)
SELECT 'csv' AS form, 'r_regionkey,r_name' || string_agg(chr(10) || r_regionkey || ',' || r_name, '' ORDER BY r_regionkey) AS result FROM r
UNION ALL SELECT 'json', '[' || string_agg('{"r_regionkey": "' || r_regionkey || '", "r_name": "' || r_name || '"}', ', ' ORDER BY r_regionkey) || ']' FROM r
UNION ALL SELECT 'markdown', '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || string_agg(chr(10) || '| ' || r_regionkey || ' | ' || r_name || ' |', '' ORDER BY r_regionkey) FROM r
UNION ALL SELECT 'html', '<table><tr><th>r_regionkey</th><th>r_name</th></tr>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</table>' FROM r
UNION ALL SELECT 'table', 'r_regionkey | r_name' || chr(10) || repeat('-', 11) || '-+-' || repeat('-', (SELECT n FROM w)::BIGINT) || string_agg(chr(10) || rpad(r_regionkey::VARCHAR, 11, ' ') || ' | ' || r_name, '' ORDER BY r_regionkey) || chr(10) || '(' || count(*) || ' rows)' FROM r
""")
