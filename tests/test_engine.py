import pytest

from lathe.catalog import ConstraintError
from lathe.engine import Engine, PrivilegeError
from lathe.lexer import SqlError


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE d (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL, n INT DEFAULT 7, CHECK (id > 0))")
    e.sql("INSERT INTO d VALUES (1, 'a', 1), (2, 'b', DEFAULT)")
    return e


def rows(engine, query):
    return sorted(tuple(r) for r in engine.sql(query).collect())


def test_constraints(engine):
    for bad in ("(1, 'x', 1)", "(-1, 'x', 1)", "(5, NULL, 1)", "(NULL, 'x', 1)"):
        with pytest.raises(ConstraintError):
            engine.sql(f"INSERT INTO d VALUES {bad}")
    assert rows(engine, "SELECT * FROM d") == [(1, "a", 1), (2, "b", 7)]


def test_failed_statement_changes_nothing(engine):
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO d VALUES (3, 'c', 1), (1, 'dup', 1)")
    with pytest.raises(ConstraintError):
        engine.sql("UPDATE d SET id = 1")
    assert len(rows(engine, "SELECT * FROM d")) == 2


def test_foreign_keys(engine):
    engine.sql("CREATE TABLE c (k INT AUTO_INCREMENT PRIMARY KEY, d INT REFERENCES d(id) ON DELETE RESTRICT)")
    engine.sql("INSERT INTO c (d) VALUES (1), (NULL)")
    assert rows(engine, "SELECT k FROM c") == [(1,), (2,)]
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO c (d) VALUES (9)")
    with pytest.raises(ConstraintError):
        engine.sql("DELETE FROM d WHERE id = 1")
    assert engine.sql("DELETE FROM d WHERE id = 2").first()[0] == 1


def test_self_reference_cascade(engine):
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, up INT REFERENCES t(id) ON DELETE CASCADE)")
    engine.sql("INSERT INTO t VALUES (1, NULL), (2, 1), (3, 2), (4, NULL)")
    engine.sql("DELETE FROM t WHERE id = 1")
    assert rows(engine, "SELECT id FROM t") == [(4,)]


def test_transactions(engine):
    engine.sql("BEGIN; DELETE FROM d; SAVEPOINT s; INSERT INTO d VALUES (8, 'h', 1); ROLLBACK TO SAVEPOINT s")
    assert rows(engine, "SELECT * FROM d") == []
    engine.sql("ROLLBACK")
    assert len(rows(engine, "SELECT * FROM d")) == 2
    with pytest.raises(SqlError):
        engine.sql("COMMIT")


def test_procedure_and_variables(engine):
    engine.sql("CREATE PROCEDURE p(INOUT x INT) BEGIN REPEAT SET x = x * 2; UNTIL x > 20 END REPEAT; INSERT INTO d VALUES (x, 'p', x); END")
    engine.sql("SET @v = 3; CALL p(@v)")
    assert rows(engine, "SELECT @v") == [(24,)]
    assert (24, "p", 24) in rows(engine, "SELECT * FROM d")


def test_trigger_depth(engine):
    engine.sql("CREATE TABLE loop_t (a INT); CREATE TRIGGER lt AFTER INSERT ON loop_t FOR EACH ROW INSERT INTO loop_t VALUES (NEW.a + 1)")
    with pytest.raises(SqlError, match="nest"):
        engine.sql("INSERT INTO loop_t VALUES (1)")


def test_views_follow_drops(engine):
    engine.sql("CREATE VIEW v AS SELECT id FROM d")
    with pytest.raises(SqlError, match="views use"):
        engine.sql("DROP TABLE d")
    engine.sql("DROP TABLE d CASCADE")
    assert not engine.catalog.state.views


def test_privileges(engine):
    engine.secure = True
    engine.sql("CREATE ROLE r; GRANT SELECT ON d TO r; SET ROLE r")
    assert len(rows(engine, "SELECT * FROM d")) == 2
    with pytest.raises(PrivilegeError):
        engine.sql("DELETE FROM d")


def test_number_conditions(engine):
    assert rows(engine, "SELECT id FROM d WHERE n - 1") == [(2,)]
    assert rows(engine, "SELECT id FROM d WHERE NULL") == []


def test_dump(engine, spark, tmp_path):
    engine.sql("CREATE TABLE c (k INT AUTO_INCREMENT PRIMARY KEY, d INT REFERENCES d(id)); INSERT INTO c (d) VALUES (1); CREATE VIEW cv AS SELECT d FROM c")
    engine.save(str(tmp_path / "dump"))
    engine.sql("DROP VIEW cv; DROP TABLE c; DROP TABLE d")
    other = Engine(spark, str(tmp_path / "other"))
    other.load(str(tmp_path / "dump"))
    assert rows(other, "SELECT * FROM cv") == [(1,)]
    other.sql("INSERT INTO c (d) VALUES (2)")
    assert rows(other, "SELECT k FROM c") == [(1,), (2,)]


def test_dbapi(spark, tmp_path):
    from lathe.dbapi import ProgrammingError, connect

    cur = connect(spark, str(tmp_path)).cursor()
    cur.execute("CREATE TABLE api_t (a INT, s VARCHAR(9))")
    assert cur.executemany("INSERT INTO api_t VALUES (?, ?)", [(1, "x'y"), (2, None)]).rowcount == 2
    cur.execute("SELECT a, s FROM api_t WHERE a >= ? ORDER BY a", [1])
    assert cur.fetchone() == (1, "x'y")
    assert cur.fetchall() == [(2, None)]
    with pytest.raises(ProgrammingError):
        cur.execute("SELECT ?", [1, 2])


def test_render(engine):
    from lathe.sources.files import render

    q = engine.sql("SELECT id, name FROM d ORDER BY id")
    assert render(q, "csv") == "id,name\n1,a\n2,b"
    assert render(q, "markdown").splitlines()[2] == "| 1 | a |"
    assert "<td>b</td>" in render(q, "html")
    assert render(q).endswith("(2 rows)")


def test_files(spark, tmp_path):
    from lathe.sources.files import read_csv, read_json, write_csv, write_json

    d = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "k int, s string")
    write_csv(d, str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), "k int, s string").collect()))[0][0] == 1
    write_json(d, str(tmp_path / "j"))
    assert {tuple(r) for r in read_json(spark, str(tmp_path / "j"), "k int, s string").collect()} == {(1, 'a,"b"'), (2, None)}
