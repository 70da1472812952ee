"""Tables as versioned Parquet snapshots, with constraints and the other definitions a database holds.

A snapshot is a list of directories. INSERT adds a directory, other statements that change a table write a new one
and point the table at it; directories are never changed, so readers and open transactions keep the version they saw. A transaction is a copy of the
definitions (which name snapshots), not of the data.
"""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.lexer import SqlError
from lathe.session import shared_dir


#: A snapshot of more directories is written as one.
MOST_PARTS = 64


class ConstraintError(SqlError):
    """A row that a constraint forbids."""


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    auto: bool = False


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    targets: list[str]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    name: str = ""


@dataclass
class Table:
    name: str
    columns: list[Column]
    primary: list[str] = field(default_factory=list)
    unique: list[tuple[str, list[str]]] = field(default_factory=list)
    checks: list[tuple[str, str]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)  # directories of the snapshot, oldest first
    next_id: int = 1

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SqlError(f"table {self.name} has no column {name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def keys(self) -> list[list[str]]:
        return [k for k in [self.primary, *(u for _, u in self.unique)] if k]


@dataclass
class Trigger:
    name: str
    table: str
    timing: str
    event: str
    columns: list[str]
    row: bool
    when: str | None
    body: list
    enabled: bool = True


@dataclass
class State:
    """All definitions; deep copies of it are what transactions and savepoints keep."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    procedures: dict[str, object] = field(default_factory=dict)
    functions: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, tuple[str, list[str], str]] = field(default_factory=dict)
    #: (kind, name) -> definition text: domains, types, sequences, collations and so on
    objects: dict[tuple[str, str], str] = field(default_factory=dict)
    roles: set[str] = field(default_factory=set)
    grants: set[tuple[str, str, str]] = field(default_factory=set)  # role, privilege, table


class Catalog:
    """Definitions and snapshots of one engine."""

    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark = spark
        self.location = location or shared_dir(spark)
        self.state = State()
        self.stack: list[tuple[str | None, State]] = []

    # Snapshots ----------------------------------------------------------------------------------

    def table(self, name: str) -> Table:
        if name.lower() not in self.state.tables:
            raise SqlError(f"there is no table {name}")
        return self.state.tables[name.lower()]

    def schema(self, table: Table) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type)) for c in table.columns])

    def read(self, table: Table) -> DataFrame:
        if not table.paths:
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(*table.paths)

    def part(self, table: Table, rows: DataFrame) -> tuple[str, DataFrame]:
        """rows written to a directory that may become part of a snapshot, and read back."""
        path = f"{self.location}/tables/{table.name.lower()}/{uuid.uuid4().hex}"
        typed = rows.select(*[F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in table.columns])
        typed.write.parquet(path)
        return path, self.spark.read.schema(self.schema(table)).parquet(path)

    def write(self, table: Table, rows: DataFrame) -> None:
        """A new snapshot of the table from rows in its column order."""
        table.paths = [self.part(table, rows)[0]]
        self.publish(table)

    def append(self, table: Table, path: str) -> None:
        """A new snapshot: the directories of the old one and another. Many small ones are written as one."""
        table.paths = [*table.paths, path]
        if len(table.paths) > MOST_PARTS:
            table.paths = [self.part(table, self.read(table))[0]]
        self.publish(table)

    def publish(self, table: Table) -> None:
        self.read(table).createOrReplaceTempView(table.name)

    def temporary(self, rows: DataFrame) -> DataFrame:
        """rows written once, so that later uses do not compute them again."""
        path = f"{self.location}/scratch/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, written once, with a column that counts them from 1 in their order; only partitions' sizes reach the driver."""
        kept = self.temporary(rows.withColumn("_at", F.monotonically_increasing_id()))
        part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
        before, starts = 0, []
        for r in sizes:
            starts.append((r["_part"], before))
            before += r["n"]
        first = self.spark.createDataFrame(starts, "_part long, _before long")
        placed = kept.withColumn("_part", part).join(F.broadcast(first), "_part")  # a row per partition of the rows
        return placed.withColumn(name, F.col("_before") + place + 1).drop("_part", "_before", "_at")

    def republish(self, before: State) -> None:
        for name in before.tables.keys() | before.views.keys():
            if name not in self.state.tables and name not in self.state.views:
                self.spark.catalog.dropTempView(name)
        for t in self.state.tables.values():
            self.publish(t)
        for name, text in self.state.views.items():
            self.spark.sql(text).createOrReplaceTempView(name)

    # Transactions -------------------------------------------------------------------------------

    def begin(self) -> None:
        if self.stack:
            raise SqlError("a transaction is open already")
        self.stack.append((None, copy.deepcopy(self.state)))

    def commit(self) -> None:
        if not self.stack:
            raise SqlError("there is no transaction to commit")
        self.stack.clear()

    def rollback(self, savepoint: str | None = None) -> None:
        at = self._find(savepoint)
        before, self.state = self.state, copy.deepcopy(self.stack[at][1])
        del self.stack[at + (savepoint is not None) :]
        self.republish(before)

    def savepoint(self, name: str) -> None:
        if not self.stack:
            raise SqlError("a savepoint needs a transaction")
        self.stack.append((name.lower(), copy.deepcopy(self.state)))

    def release(self, name: str) -> None:
        del self.stack[self._find(name) :]

    def _find(self, name: str | None) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == (name and name.lower()):
                return i
        raise SqlError(f"there is no {'savepoint ' + name if name else 'open transaction'}")

    # Constraints --------------------------------------------------------------------------------

    def check_rows(self, table: Table, rows: DataFrame, express) -> None:
        """NOT NULL and CHECK over rows; express rewrites a condition. One pass over the rows."""
        tests = [(f"{c.name} is not null", F.col(f"`{c.name}`").isNull()) for c in table.columns if not c.nullable or c.name in table.primary]
        tests += [(name or text, ~F.coalesce(F.expr(express(text)), F.lit(True))) for name, text in table.checks]
        if not tests:
            return
        counts = rows.agg(*[F.sum(t.cast("int")).alias(f"t{i}") for i, (_, t) in enumerate(tests)]).first()
        for i, (what, _) in enumerate(tests):
            if counts[i]:
                raise ConstraintError(f"{counts[i]} rows of {table.name} violate: {what}")

    def check_keys(self, table: Table, rows: DataFrame, old: DataFrame | None = None) -> None:
        """PRIMARY KEY and UNIQUE over all rows, or over rows that join the old ones, which are free of duplicates. A key with a NULL is never a duplicate."""
        for key in table.keys():
            cols = [F.col(f"`{c}`") for c in key]
            known = rows.select(*cols).na.drop()
            twice = known.groupBy(*cols).count().filter("count > 1")
            if not twice.isEmpty() or old is not None and not known.join(old.select(*cols), list(key), "left_semi").isEmpty():
                raise ConstraintError(f"duplicate key ({', '.join(key)}) in {table.name}")

    def check_references(self, table: Table, rows: DataFrame, old: DataFrame | None = None) -> None:
        """Every foreign key of rows without NULL has its row; a table that refers to itself sees the rows and the old ones too."""
        for fk in table.foreign:
            own_rows = rows if old is None else old.unionByName(rows)
            target = own_rows if fk.table.lower() == table.name.lower() else self.read(self.table(fk.table))
            own = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(fk.columns)]).na.drop()
            there = target.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(fk.targets)])
            if not own.join(there, [f"k{i}" for i in range(len(fk.columns))], "left_anti").isEmpty():
                raise ConstraintError(f"{table.name} ({', '.join(fk.columns)}) refers to rows that {fk.table} does not have")

    def children(self, table: Table) -> list[tuple[Table, ForeignKey]]:
        return [(t, fk) for t in self.state.tables.values() for fk in t.foreign if fk.table.lower() == table.name.lower()]
