import pytest

from lathe.dialect import booleans, rewrite
from lathe.functions.masks import java_pattern, number_text
from lathe.lexer import SqlError, statements, tokenize


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("SELECT a / b FROM t", "a / nullif(b, 0)"),
        ("SELECT a % (b + 1) FROM t", "a % nullif((b + 1), 0)"),
        ("SELECT '1 / 2 ORDER BY x' FROM t", "'1 / 2 ORDER BY x'"),
        ('SELECT "order / by" FROM t', "`order / by`"),
        ("SELECT a /* / b */ FROM t -- / c", "SELECT a FROM t"),
        ("SELECT a FROM t ORDER BY a DESC, b", "ORDER BY a DESC NULLS LAST, b NULLS LAST"),
        ("SELECT a FROM t ORDER BY a NULLS FIRST", "ORDER BY a NULLS FIRST"),
        ("SELECT COUNT(*) OVER (ORDER BY a) FROM t", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
        ("SELECT LAST_VALUE(a) OVER (ORDER BY b ROWS 1 PRECEDING) FROM t", "ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"),
        ("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3", "(SELECT 1 UNION SELECT 2) INTERSECT SELECT 3"),
        ("SELECT LENGTH(a) FROM t", "octet_length(a)"),
        ("SELECT a FROM t WHERE a IN ()", "WHERE false"),
        ("SELECT a FROM t WHERE a = ANY (SELECT b FROM u)", "(a IN (SELECT b FROM u))"),
    ],
)
def test_rewrite(text, part):
    assert part in rewrite(text)



def test_backslashes():
    assert rewrite(r"SELECT 'a\b'") == r"SELECT 'a\\b'"
    assert rewrite(r"SELECT a LIKE 'a\b'") == r"SELECT a LIKE 'a\\\\b'"


def test_booleans():
    assert booleans("SELECT 1 FROM t WHERE a GROUP BY b") == "SELECT 1 FROM t WHERE CAST((a) AS BOOLEAN) GROUP BY b"


def test_errors():
    with pytest.raises(SqlError):
        tokenize("SELECT 'open")
    with pytest.raises(SqlError):
        rewrite("SELECT (1")


def test_statements():
    assert len(statements("SELECT 1; CREATE PROCEDURE p() BEGIN SET a = 1; IF a THEN SET a = 2; END IF; END; SELECT ';'")) == 3


def test_masks():
    assert java_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    assert "format_number" in number_text("x", "$9,999.99")


def test_values(spark):
    one = lambda q: spark.sql(rewrite(q)).first()[0]
    assert one("SELECT 5 / 0") is None
    assert one("SELECT 5 % 0") is None
    assert one("SELECT 3 BETWEEN SYMMETRIC 5 AND 1") is True
    assert one("SELECT 3 BETWEEN SYMMETRIC NULL AND 1") is None
    assert one("SELECT TRIM(BOTH 'ab' FROM 'ababxab')") == "x"
    assert one("SELECT SUBSTRING('hello', -3, 2)") == "he"
    assert one("SELECT TRUNCATE(-1.57, 1)") == pytest.approx(-1.5)
    assert one("SELECT TO_CHAR(-1234.5, '$9,999.00')") == "-$1,234.50"
    assert one("SELECT 1 > ALL (SELECT n FROM (SELECT 1 AS n WHERE 1 = 0) x)") is True
    assert one("SELECT NULL > ANY (SELECT n FROM (SELECT 1 AS n) x)") is None
    with pytest.raises(Exception, match="SQRT"):
        one("SELECT SQRT(-1)")


def test_fulltext(spark):
    q = lambda text, query, mode="": spark.sql(rewrite(f"SELECT MATCH(t) AGAINST ('{query}' {mode}) FROM (SELECT '{text}' AS t) x")).first()[0]
    assert q("The quick brown fox", "brown dog") is True
    assert q("The quick brown fox", "bro") is False
    assert q("The quick brown fox", "+quick -fox", "IN BOOLEAN MODE") is False
    assert q("The quick brown fox", '+"quick brown"', "IN BOOLEAN MODE") is True
    assert q("", "dog") is False
    assert q("anything", "the of") is True
