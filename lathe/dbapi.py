"""A DB-API 2.0 connection over an Engine. Parameters are question marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from lathe.engine import Engine, literal
from lathe.lexer import SqlError, tokenize

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    pass


class ProgrammingError(Error):
    pass


def bind(sql: str, parameters: Sequence) -> str:
    """Question marks outside of literals and names replaced by values."""
    out, left = [], list(parameters)
    for t in tokenize(sql):
        if t.up == "?":
            if not left:
                raise ProgrammingError("too few parameters")
            out.append(literal(left.pop(0)))
        else:
            out.append(t.text)
    if left:
        raise ProgrammingError("too many parameters")
    return " ".join(out)


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount, self._rows = connection, None, -1, iter(())

    def execute(self, sql: str, parameters: Sequence = ()) -> Cursor:
        try:
            result = self.connection.engine.sql(bind(sql, parameters) if parameters else sql)
        except SqlError as e:
            raise ProgrammingError(str(e)) from e
        self.description, self.rowcount, self._rows = None, -1, iter(())
        if result is not None and result.columns == ["affected"]:
            self.rowcount = result.first()[0]
        elif result is not None:
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in result.schema.fields]
            self._rows = (tuple(r) for r in result.toLocalIterator())
        return self

    def executemany(self, sql: str, many: Sequence[Sequence]) -> Cursor:
        total = 0
        for parameters in many:
            total += max(0, self.execute(sql, parameters).rowcount)
        self.rowcount = total
        return self

    def fetchone(self) -> tuple | None:
        return next(self._rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [r for _, r in zip(range(size or self.arraysize), self._rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def __iter__(self):
        return self._rows

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    def __init__(self, engine: Engine):
        self.engine = engine

    def cursor(self) -> Cursor:
        return Cursor(self)

    def commit(self) -> None:
        if self.engine.catalog.stack:
            self.engine.catalog.commit()

    def rollback(self) -> None:
        if self.engine.catalog.stack:
            self.engine.catalog.rollback()

    def close(self) -> None:
        self.rollback()


def connect(spark: SparkSession | None = None, location: str | None = None) -> Connection:
    from lathe.session import session

    return Connection(Engine(spark or session(), location))
