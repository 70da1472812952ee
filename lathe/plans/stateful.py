"""Queries that change state on tables of their own, and spatial queries: their results as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.engine import Engine
from lathe.functions import spatial
from lathe.operators.spatial_join import spatial_join
from lathe.plans.registry import add
from lathe.session import register, table


def script(name: str, source: str, statements: str, result: str, oracle: str) -> None:
    """Tables a (and b) made from Parquet tables by `source`, then statements, then a query. Table names get a suffix of their own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        engine, own = Engine(spark), uuid.uuid4().hex[:8]
        named = lambda text: text.replace("{a}", f"a_{own}").replace("{b}", f"b_{own}").replace("{v}", f"v_{own}")
        engine.sql(named(source))
        engine.sql(named(statements))
        return engine.sql(named(result))

    add(name, run, oracle)


_NATIONS = "CREATE TABLE {a} (k INTEGER PRIMARY KEY, name VARCHAR(30) NOT NULL, r INTEGER DEFAULT 7); INSERT INTO {a} SELECT n_nationkey, n_name, n_regionkey FROM nation;"
_BASE = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation"
_ALL = "SELECT k, name, r FROM {a}"

script("dml_insert_values", _NATIONS, "INSERT INTO {a} (k, name) VALUES (100, 'x'), (101, 'it''s'); INSERT INTO {a} VALUES (102, 'y', DEFAULT), (103, 'z', NULL)", _ALL, f"{_BASE} UNION ALL VALUES (100, 'x', 7), (101, 'it''s', 7), (102, 'y', 7), (103, 'z', NULL)")
script("dml_insert_select", _NATIONS, "INSERT INTO {a} SELECT r_regionkey + 200, r_name, r_regionkey FROM region", _ALL, f"{_BASE} UNION ALL SELECT r_regionkey + 200, r_name, r_regionkey FROM region")
script("dml_insert_ignore", _NATIONS, "INSERT IGNORE INTO {a} VALUES (1, 'no', 0), (100, 'yes', 0), (100, 'again', 1)", "SELECT k, r FROM {a}", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation UNION ALL VALUES (100, 0)")
script("dml_replace", _NATIONS, "REPLACE INTO {a} VALUES (1, 'new', 9), (100, 'more', 8)", _ALL, f"SELECT * FROM ({_BASE}) WHERE k <> 1 UNION ALL VALUES (1, 'new', 9), (100, 'more', 8)")
script("dml_upsert", _NATIONS, "INSERT INTO {a} VALUES (2, 'two', 10), (100, 'c', 1) ON DUPLICATE KEY UPDATE r = r + VALUES(r), name = VALUES(name)", _ALL, f"SELECT k, CASE WHEN k = 2 THEN 'two' ELSE name END AS name, CASE WHEN k = 2 THEN r + 10 ELSE r END AS r FROM ({_BASE}) UNION ALL VALUES (100, 'c', 1)")
script("dml_update", _NATIONS, "UPDATE {a} SET r = r * 10, name = name || '!' WHERE k % 2 = 0 AND r IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1); UPDATE {a} SET r = DEFAULT WHERE k = 3", _ALL, f"SELECT k, CASE WHEN k % 2 = 0 AND r > 1 THEN name || '!' ELSE name END AS name, CASE WHEN k = 3 THEN 7 WHEN k % 2 = 0 AND r > 1 THEN r * 10 ELSE r END AS r FROM ({_BASE})")
script("dml_delete", _NATIONS, "DELETE FROM {a} WHERE r = 2 OR k > (SELECT avg(n_nationkey) + 8 FROM nation)", _ALL, f"SELECT * FROM ({_BASE}) WHERE NOT (r = 2 OR k > 20)")
script("dml_truncate", _NATIONS, "TRUNCATE TABLE {a}; INSERT INTO {a} VALUES (1, 'only', 1)", _ALL, "SELECT CAST(1 AS BIGINT) AS k, 'only' AS name, CAST(1 AS BIGINT) AS r")
_CHILD = "CREATE TABLE {a} (k INTEGER PRIMARY KEY); INSERT INTO {a} SELECT r_regionkey FROM region; CREATE TABLE {b} (n INTEGER PRIMARY KEY, k INTEGER DEFAULT 0 REFERENCES {a}(k) ON DELETE %s ON UPDATE CASCADE); INSERT INTO {b} SELECT n_nationkey, n_regionkey FROM nation;"
script("fk_delete_cascade", _CHILD % "CASCADE", "DELETE FROM {a} WHERE k = 2", "SELECT n, k FROM {b}", "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS k FROM nation WHERE n_regionkey <> 2")
script("fk_delete_set_null", _CHILD % "SET NULL", "DELETE FROM {a} WHERE k = 2", "SELECT n, k FROM {b}", "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(nullif(n_regionkey, 2) AS BIGINT) AS k FROM nation")
script("fk_delete_set_default", _CHILD % "SET DEFAULT", "DELETE FROM {a} WHERE k = 2", "SELECT n, k FROM {b}", "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(CASE WHEN n_regionkey = 2 THEN 0 ELSE n_regionkey END AS BIGINT) AS k FROM nation")
script("fk_update_cascade", _CHILD % "CASCADE", "UPDATE {a} SET k = k + 50 WHERE k >= 3", "SELECT n, k FROM {b}", "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(CASE WHEN n_regionkey >= 3 THEN n_regionkey + 50 ELSE n_regionkey END AS BIGINT) AS k FROM nation")
script("txn_rollback", _NATIONS, "BEGIN; DELETE FROM {a} WHERE k < 10; SAVEPOINT s; DELETE FROM {a}; ROLLBACK TO SAVEPOINT s; COMMIT; BEGIN; DELETE FROM {a}; ROLLBACK", _ALL, f"SELECT * FROM ({_BASE}) WHERE k >= 10")
script("ddl_alter", _NATIONS, "ALTER TABLE {a} ADD COLUMN z INTEGER DEFAULT 5; ALTER TABLE {a} RENAME COLUMN r TO region; ALTER TABLE {a} DROP COLUMN name", "SELECT k, region, z FROM {a}", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS region, CAST(5 AS BIGINT) AS z FROM nation")
script("view", _NATIONS, "CREATE VIEW {v} (key, label) AS SELECT k, upper(name) FROM {a} WHERE r < 3", "SELECT key, label FROM {v}", "SELECT CAST(n_nationkey AS BIGINT) AS key, upper(n_name) AS label FROM nation WHERE n_regionkey < 3")
script("select_into", _NATIONS, "SELECT k, name INTO {b} FROM {a} WHERE k = 4", "SELECT k, name FROM {b}", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation WHERE n_nationkey = 4")
script("trigger_row", _NATIONS, "CREATE TABLE {b} (what VARCHAR(9), k INTEGER); CREATE TRIGGER t AFTER UPDATE OF r ON {a} FOR EACH ROW WHEN (NEW.r > 20) INSERT INTO {b} VALUES ('up', NEW.k * 1000 + OLD.r); UPDATE {a} SET r = r * 10", "SELECT what, k FROM {b}", "SELECT 'up' AS what, CAST(n_nationkey * 1000 + n_regionkey AS BIGINT) AS k FROM nation WHERE n_regionkey * 10 > 20")
script("routine_function", "", "CREATE FUNCTION f_{a}(x INTEGER, y INTEGER) RETURNS INTEGER BEGIN DECLARE z INTEGER DEFAULT 3; RETURN x * z + y; END", "SELECT n_nationkey AS k, f_{a}(n_nationkey, n_regionkey) AS v FROM nation", "SELECT n_nationkey AS k, CAST(n_nationkey * 3 + n_regionkey AS BIGINT) AS v FROM nation")
script("routine_procedure", "", "CREATE PROCEDURE p_{a}(IN n INTEGER, OUT s INTEGER) BEGIN DECLARE i INTEGER DEFAULT 0; SET s = 0; up: LOOP SET i = i + 1; IF i > n THEN LEAVE up; ELSEIF i = 2 THEN ITERATE up; END IF; SET s = s + i; END LOOP; END; CALL p_{a}(5, @s)", "SELECT @s AS s", "SELECT 13 AS s")


def _spatial(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, "nation")
        spatial.register(spark)
        return Engine(spark).sql(text)

    add(name, run, oracle)


_P, _SQ = "concat('POINT(', n_nationkey, ' ', n_regionkey, ')')", "'POLYGON((2 1, 12 1, 12 3, 2 3, 2 1))'"
_spatial("spatial_predicates", f"SELECT n_nationkey, ST_Contains({_SQ}, {_P}) AS c, ST_Intersects({_SQ}, {_P}) AS i, ST_Touches({_P}, {_SQ}) AS t, ST_Disjoint({_P}, {_SQ}) AS d FROM nation",
         "SELECT n_nationkey, n_nationkey > 2 AND n_nationkey < 12 AND n_regionkey > 1 AND n_regionkey < 3 AS c, i, i AND NOT (n_nationkey > 2 AND n_nationkey < 12 AND n_regionkey > 1 AND n_regionkey < 3) AS t, NOT i AS d FROM (SELECT *, n_nationkey BETWEEN 2 AND 12 AND n_regionkey BETWEEN 1 AND 3 AS i FROM nation)")
_spatial("spatial_measures", f"SELECT n_nationkey, ROUND(ST_Distance({_P}, 'POINT(3 4)'), 9) AS d, ST_X({_P}) AS x, ST_Y({_P}) AS y, ST_Area({_SQ}) AS a, ST_Perimeter({_SQ}) AS p, ST_Length('LINESTRING(0 0, 3 4)') AS l, ST_AsText(ST_Centroid({_SQ})) AS c, ST_DWithin({_P}, 'POINT(0 0)', 900000) AS w, ST_DWithin({_P}, 'LINESTRING(0 0, 0 9)', 5) AS v, ST_DWithin({_P}, {_P}, -1) AS m FROM nation",
         "SELECT n_nationkey, round(sqrt(power(n_nationkey - 3, 2) + power(n_regionkey - 4, 2)), 9) AS d, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y, 20.0::DOUBLE AS a, 24.0::DOUBLE AS p, 5.0::DOUBLE AS l, 'POINT(7 2)' AS c, 2 * 6371008.8::DOUBLE * asin(sqrt(power(sin(radians(n_regionkey) / 2), 2) + cos(radians(n_regionkey)) * power(sin(radians(n_nationkey) / 2), 2))) <= 900000 AS w, n_nationkey <= 5 AS v, false AS m FROM nation")
_spatial("spatial_overlay", f"SELECT n_nationkey, ST_Area(ST_Intersection({_SQ}, concat('POLYGON((', n_nationkey, ' 0, ', n_nationkey + 1, ' 0, ', n_nationkey + 1, ' 9, ', n_nationkey, ' 9, ', n_nationkey, ' 0))'))) AS a, ST_Area(ST_Union({_SQ}, 'POLYGON((0 0, 4 0, 4 2, 0 2, 0 0))')) AS u, ST_Area(ST_Difference({_SQ}, 'POLYGON((0 0, 4 0, 4 2, 0 2, 0 0))')) AS d FROM nation",
         "SELECT n_nationkey, CASE WHEN n_nationkey >= 2 AND n_nationkey < 12 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS a, 26.0::DOUBLE AS u, 18.0::DOUBLE AS d FROM nation")


def _join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_custkey", F.format_string("POINT(%s %s)", F.col("c_custkey") % 50, (F.col("c_custkey") / 50).cast("int") % 50).alias("p"))
    x, y = (F.col("n_nationkey") % 5 * 10).cast("int"), (F.col("n_nationkey") / 5).cast("int") * 10
    boxes = table(spark, sf_dir, "nation").select("n_nationkey", F.format_string("POLYGON((%1$s %2$s, %3$s %2$s, %3$s %4$s, %1$s %4$s, %1$s %2$s))", x, y, x + 7, y + 7).alias("box"))
    return spatial_join(points, boxes, "p", "box", "st_intersects", 10.0).select("c_custkey", "n_nationkey")


add("spatial_join", _join, """
SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, c_custkey % 50 AS x, (c_custkey // 50) % 50 AS y FROM customer) c
JOIN (SELECT n_nationkey, n_nationkey % 5 * 10 AS x0, n_nationkey // 5 * 10 AS y0 FROM nation) n ON x BETWEEN x0 AND x0 + 7 AND y BETWEEN y0 AND y0 + 7""")
