"""Engine.sql(text) -> DataFrame: statements of the dialect over Spark and a catalog of snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.catalog import Catalog, Column, ForeignKey, Table, Trigger
from lathe.dialect import Rewriter, booleans, cast_type
from lathe.dml import Writer
from lathe.lexer import Group, Item, SqlError, Token, name_of, parse, split, statements, text_of

_QUERY = ("SELECT", "WITH", "VALUES", "()", "TABLE")
#: Objects that are only defined: CREATE <kind> name ..., DROP <kind> name.
_OBJECTS = ("DOMAIN", "TYPE", "SEQUENCE", "COLLATION", "TRANSLATION", "ASSERTION")
_DEPTH = 16
#: Rows of a statement that a row trigger's UPDATE, DELETE or INSERT ... SELECT runs for, each on the driver.
_ROWS = 1_000


class PrivilegeError(SqlError):
    """A statement that the current role may not run."""


class Engine:
    """One session: tables, views, routines, transactions and variables.

    Tables of an sf directory can be registered with lathe.session.register and queried beside the engine's own.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, secure: bool = False):
        self.spark = spark
        self.catalog = Catalog(spark, location)
        self.writer = Writer(self.catalog, self.express, self._fire)
        self.variables: dict[str, str] = {"@@sql_mode": "'mysql'", "@@version": "'lathe'", "@@autocommit": "1"}
        self.secure, self.role = secure, "admin"
        self._depth = 0

    # Entry --------------------------------------------------------------------------------------

    def sql(self, text: str) -> DataFrame | None:
        """Run a script; the last statement's result: rows of a query, affected of a change, else None."""
        result = None
        for items in statements(text):
            result = self.statement(items)
        return result

    def express(self, text: str) -> str:
        return Rewriter(self.variables).sql(text)

    def query(self, items: list[Item]) -> DataFrame:
        self._allow_reads(items)
        text = Rewriter(self.variables).text(items)
        try:
            return self.spark.sql(text)
        except AnalysisException as e:
            if "FILTER_NOT_BOOLEAN" not in str(e) and "DATATYPE_MISMATCH" not in str(e) and "HAVING" not in str(e):
                raise
            return self.spark.sql(booleans(text))

    def statement(self, items: list[Item]) -> DataFrame | None:
        up = [x.up for x in items[:4]] + [""] * 4
        head = up[0]
        if head in _QUERY:
            into = next((i for i, x in enumerate(items) if x.up == "INTO"), None)
            return self.query(items) if into is None or head != "SELECT" else self._select_into(items, into)
        run = getattr(self, f"_{head.lower()}", None)
        if run is None:
            raise SqlError(f"unknown statement {head or text_of(items[:1])}")
        return run(items)

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected long")

    # Queries into tables and variables -----------------------------------------------------------

    def _select_into(self, items: list[Item], at: int) -> DataFrame | None:
        end = next((i for i in range(at + 1, len(items)) if items[i].up == "FROM"), len(items))
        targets = [t[0] for t in split(items[at + 1 : end])]
        rows = self.query([*items[:at], *items[end:]])
        found = rows.limit(2).collect()
        if targets[0].text.startswith("@") or self._locals is not None:
            if len(found) > 1:
                raise SqlError("SELECT INTO needs at most one row")
            values = found[0] if found else [None] * len(targets)
            for t, v in zip(targets, values, strict=True):
                self._assign(t.text.lower(), literal(v))
            return None
        if len(found) != 1:
            raise SqlError("SELECT INTO needs exactly one row")
        name = name_of(targets[0])
        if name in self.catalog.state.tables:
            raise SqlError(f"table {name} exists")
        table = Table(name, [Column(f.name, f.dataType.simpleString()) for f in rows.schema.fields])
        self.catalog.state.tables[name] = table
        self.catalog.write(table, rows)
        return self._affected(1)

    # Definitions --------------------------------------------------------------------------------

    def _create(self, items: list[Item]) -> None:
        i, replace = 1, False
        if items[1].up == "OR":
            i, replace = 3, True
        while items[i].up in ("TEMPORARY", "TEMP", "UNIQUE", "FULLTEXT", "SPATIAL"):
            i += 1
        kind = items[i].up
        if kind == "TABLE":
            self._create_table(items, i + 1)
        elif kind == "VIEW":
            self._create_view(items, i + 1, replace)
        elif kind == "INDEX":
            self._create_index(items, i)
        elif kind in ("SCHEMA", "DATABASE"):
            j, quiet = self._if(items, i + 1, "NOT")
            self.spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' * quiet}{name_of(items[j])}")
        elif kind == "ROLE":
            self.catalog.state.roles.add(name_of(items[i + 1]))
        elif kind in ("FUNCTION", "PROCEDURE"):
            from lathe import routines

            routines.define(self, kind, items, i + 1, replace)
        elif kind == "TRIGGER":
            self._create_trigger(items, i + 1)
        elif kind in _OBJECTS or kind == "CHARACTER":
            j = i + 2 if kind == "CHARACTER" else i + 1
            key = ("CHARACTER SET" if kind == "CHARACTER" else kind, name_of(items[j]))
            if key in self.catalog.state.objects:
                raise SqlError(f"{key[0]} {key[1]} exists")
            self.catalog.state.objects[key] = text_of(items[j + 1 :])
        else:
            raise SqlError(f"unknown statement CREATE {kind}")

    @staticmethod
    def _if(items: list[Item], i: int, word: str = "") -> tuple[int, bool]:
        """Skip IF [NOT] EXISTS."""
        if i < len(items) and items[i].up == "IF":
            return i + (3 if word else 2), True
        return i, False

    def _type(self, items: list[Item]) -> str:
        text = text_of(items)
        domain = self.catalog.state.objects.get(("DOMAIN", text.lower())) or self.catalog.state.objects.get(("TYPE", text.lower()))
        if domain:
            words = parse(domain)
            words = words[1:] if words and words[0].up == "AS" else words
            stop = next((k for k, x in enumerate(words) if x.up in ("CHECK", "CONSTRAINT", "DEFAULT", "FINAL", "NOT")), len(words))
            text = text_of(words[:stop])
        spark_type = cast_type(text)
        known = spark_type.partition("(")[0].strip()
        if known in ("POINT", "LINESTRING", "POLYGON", "GEOMETRY", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "JSON", "UUID", "ENUM", "SET"):
            return "STRING"
        return {"BOOL": "BOOLEAN", "YEAR": "INT", "BIT": "BIGINT", "DATE": "DATE"}.get(known, "STRING" if known in ("CHAR", "VARCHAR") else spark_type.lower())

    def _create_table(self, items: list[Item], i: int) -> None:
        i, quiet = self._if(items, i, "NOT")
        name = name_of(items[i])
        if name in self.catalog.state.tables:
            if quiet:
                return
            raise SqlError(f"table {name} exists")
        table = Table(name, [])
        body = items[i + 1] if i + 1 < len(items) else None
        if not isinstance(body, Group):  # CREATE TABLE t AS SELECT
            at = next((k for k, x in enumerate(items) if x.up == "AS"), None)
            if at is None:
                raise SqlError("CREATE TABLE without columns")
            rows = self.query(items[at + 1 :])
            table.columns = [Column(f.name, f.dataType.simpleString()) for f in rows.schema.fields]
            self.catalog.state.tables[name] = table
            self.catalog.write(table, rows)
            return
        for part in split(body.items):
            if not self._constraint(table, part):
                self._column(table, part)
        self.catalog.state.tables[name] = table
        self.catalog.publish(table)

    def _column(self, table: Table, part: list[Item]) -> Column:
        stops = {"NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "CHECK", "REFERENCES", "AUTO_INCREMENT", "AUTOINCREMENT", "CONSTRAINT", "COMMENT", "COLLATE", "KEY", "GENERATED"}
        k = 1
        while k < len(part) and part[k].up not in stops:
            k += 1
        name = name_of(part[0])
        column = Column(name, self._type(part[1:k]))
        domain = self.catalog.state.objects.get(("DOMAIN", text_of(part[1:k]).lower()))
        if domain and (checks := [x for p, x in zip(parse(domain), parse(domain)[1:], strict=False) if p.up == "CHECK"]):
            swap = lambda xs: [Group(swap(x.items)) if isinstance(x, Group) else part[0] if x.up == "VALUE" else x for x in xs]
            table.checks += [("", text_of(swap(c.items))) for c in checks]
        if domain:
            words = parse(domain)
            column.nullable = not any(p.up == "NOT" and x.up == "NULL" for p, x in zip(words, words[1:], strict=False))
            if (at := next((j for j, x in enumerate(words) if x.up == "DEFAULT"), None)) is not None:
                end = next((j for j in range(at + 2, len(words)) if words[j].up in stops), len(words))
                column.default = text_of(words[at + 1 : end])
        table.columns.append(column)
        while k < len(part):
            word = part[k].up
            if word == "NOT":
                column.nullable, k = False, k + 2
            elif word == "DEFAULT":
                end = k + 2
                while end < len(part) and part[end].up not in stops:
                    end += 1
                column.default, k = text_of(part[k + 1 : end]), end
            elif word == "PRIMARY":
                table.primary, k = [name], k + 2
            elif word == "UNIQUE":
                table.unique.append(("", [name]))
                k += 1
            elif word in ("AUTO_INCREMENT", "AUTOINCREMENT"):
                column.auto, k = True, k + 1
            elif word == "CHECK":
                table.checks.append(("", text_of(part[k + 1].items)))
                k += 2
            elif word == "REFERENCES":
                fk, k = self._references(part, k, [name])
                table.foreign.append(fk)
            else:
                k += 2 if word in ("CONSTRAINT", "COMMENT", "COLLATE") else 1
        return column

    def _constraint(self, table: Table, part: list[Item]) -> bool:
        name, k = "", 0
        if part[0].up == "CONSTRAINT":
            name, k = name_of(part[1]), 2
        word = part[k].up
        columns = lambda g: [table.column(name_of(c[0])).name if table.columns else name_of(c[0]) for c in split(g.items)]
        groups = [x for x in part[k:] if isinstance(x, Group)]
        if word == "PRIMARY" and part[k + 1].up == "KEY":
            table.primary = columns(groups[0])
        elif word == "UNIQUE" and groups:
            table.unique.append((name, columns(groups[0])))
        elif word == "CHECK":
            table.checks.append((name, text_of(groups[0].items)))
        elif word == "FOREIGN":
            at = next(i for i, x in enumerate(part) if x.up == "REFERENCES")
            fk, _ = self._references(part, at, columns(groups[0]))
            fk.name = name
            table.foreign.append(fk)
        elif word in ("INDEX", "KEY", "FULLTEXT", "SPATIAL") and groups and len(part) - k <= 4:
            pass
        else:
            return False
        return True

    def _references(self, part: list[Item], k: int, columns: list[str]) -> tuple[ForeignKey, int]:
        target, k = name_of(part[k + 1]), k + 2
        own = self.catalog.state.tables.get(target)
        if k < len(part) and isinstance(part[k], Group):
            targets, k = [name_of(c[0]) for c in split(part[k].items)], k + 1
        else:
            targets = own.primary if own else columns
        fk = ForeignKey(columns, target, targets)
        while k + 2 < len(part) + 1 and k < len(part) and part[k].up == "ON":
            two = part[k + 2].up in ("SET", "NO")
            action = f"{part[k + 2].up} {part[k + 3].up}" if two else part[k + 2].up
            setattr(fk, f"on_{part[k + 1].up.lower()}", action)
            k += 4 if two else 3
        return fk, k

    def _create_view(self, items: list[Item], i: int, replace: bool) -> None:
        i, quiet = self._if(items, i, "NOT")
        name = name_of(items[i])
        if name in self.catalog.state.views and not replace:
            if quiet:
                return
            raise SqlError(f"view {name} exists")
        at = next(k for k, x in enumerate(items) if x.up == "AS")
        end = next((k for k in range(len(items) - 1, at, -1) if items[k].up == "WITH" and items[-1].up == "OPTION"), len(items))
        text = Rewriter(self.variables).text(items[at + 1 : end])
        if isinstance(items[i + 1], Group):
            names = ", ".join(f"`{name_of(c[0])}`" for c in split(items[i + 1].items))
            text = f"SELECT * FROM ({text}) AS v({names})"
        self.spark.sql(text).createOrReplaceTempView(name)
        self.catalog.state.views[name] = text

    def _create_index(self, items: list[Item], i: int) -> None:
        j, quiet = self._if(items, i + 1, "NOT")
        name, table = name_of(items[j]), self.catalog.table(name_of(items[j + 2]))
        columns = [table.column(name_of(c[0])).name for c in split(items[j + 3].items)]
        if name in self.catalog.state.indexes:
            if quiet:
                return
            raise SqlError(f"index {name} exists")
        kind = items[i - 1].up
        if kind == "UNIQUE":
            table.unique.append((name, columns))
            try:
                self.catalog.check_keys(table, self.catalog.read(table))
            except SqlError:
                table.unique.pop()
                raise
        self.catalog.state.indexes[name] = (table.name, columns, kind if kind != "CREATE" else "")

    def _create_trigger(self, items: list[Item], i: int) -> None:
        name, timing, event = name_of(items[i]), items[i + 1].up, items[i + 2].up
        if timing == "INSTEAD":
            raise SqlError("INSTEAD OF triggers are not fired")
        k, columns = i + 3, []
        if items[k].up == "OF":
            on = next(j for j in range(k, len(items)) if items[j].up == "ON")
            columns, k = [name_of(c[0]) for c in split(items[k + 1 : on])], on
        table = self.catalog.table(name_of(items[k + 1])).name
        k, row, when = k + 2, False, None
        if items[k].up == "FOR":
            k += 1 + (items[k + 1].up == "EACH")
            row, k = items[k].up == "ROW", k + 1
        if items[k].up == "WHEN":
            when, k = text_of(items[k + 1].items), k + 2
        body = items[k:]
        if body[0].up == "BEGIN":
            body = body[1:-1]
        self.catalog.state.triggers[name] = Trigger(name, table, timing, event, columns, row, when, [s for s in split(body, ";") if s])

    def _drop(self, items: list[Item]) -> None:
        state, kind = self.catalog.state, items[1].up
        k, quiet = self._if(items, 2 + (kind == "CHARACTER"))
        name = name_of(items[k])
        cascade = items[-1].up == "CASCADE"
        stores = {"TABLE": state.tables, "VIEW": state.views, "INDEX": state.indexes, "TRIGGER": state.triggers, "PROCEDURE": state.procedures, "FUNCTION": state.functions}
        if kind in stores:
            if name not in stores[kind]:
                if quiet:
                    return
                raise SqlError(f"there is no {kind.lower()} {name}")
            if kind == "TABLE":
                table = state.tables[name]
                if any(c is not table for c, _ in self.catalog.children(table)) and not cascade:
                    raise SqlError(f"other tables refer to {name}")
                for child, fk in self.catalog.children(table):
                    child.foreign.remove(fk)
                state.triggers = {n: t for n, t in state.triggers.items() if t.table != name}
                state.indexes = {n: x for n, x in state.indexes.items() if x[0] != name}
            if kind in ("TABLE", "VIEW"):
                using = [v for v, text in state.views.items() if v != name and any(t.kind in ("word", "quoted") and t.text.strip("`").lower() == name for t in _flat(parse(text)))]
                if using and not cascade:
                    raise SqlError(f"views use {name}: {', '.join(using)}")
                for v in using:
                    del state.views[v]
                    self.spark.catalog.dropTempView(v)
                self.spark.catalog.dropTempView(name)
            if kind == "INDEX":
                table, _, unique = state.indexes[name]
                state.tables[table].unique = [u for u in state.tables[table].unique if u[0] != name]
            if kind == "FUNCTION":
                self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
            del stores[kind][name]
        elif kind in ("SCHEMA", "DATABASE"):
            self.spark.sql(f"DROP DATABASE {'IF EXISTS ' * quiet}{name} {'CASCADE' * cascade}")
        elif kind == "ROLE":
            state.roles.discard(name)
            state.grants = {g for g in state.grants if g[0] != name}
        elif state.objects.pop(("CHARACTER SET" if kind == "CHARACTER" else kind, name), None) is None and not quiet:
            raise SqlError(f"there is no {kind.lower()} {name}")

    def _alter(self, items: list[Item]) -> None:
        if items[1].up == "TRIGGER":
            self.catalog.state.triggers[name_of(items[2])].enabled = items[3].up == "ENABLE"
            return
        if items[1].up == "SEQUENCE":
            self.catalog.state.objects[("SEQUENCE", name_of(items[2]))] = text_of(items[3:])
            return
        table = self.catalog.table(name_of(items[2]))
        for part in split(items[3:]):
            self._alter_one(table, part)

    def _alter_one(self, table: Table, part: list[Item]) -> None:
        catalog, what = self.catalog, part[0].up
        rest = part[2:] if len(part) > 1 and part[1].up == "COLUMN" else part[1:]
        rows = catalog.read(table)
        if what == "ADD" and rest[0].up in ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
            before = (list(table.primary), list(table.unique), list(table.checks), list(table.foreign))
            self._constraint(table, rest)
            try:
                catalog.check_rows(table, rows, self.express)
                catalog.check_keys(table, rows)
                catalog.check_references(table, rows)
            except SqlError:
                table.primary, table.unique, table.checks, table.foreign = before
                raise
        elif what == "ADD":
            column = self._column(table, rest)
            value = F.expr(self.express(column.default)) if column.default is not None else F.lit(None)
            catalog.write(table, rows.withColumn(column.name, value.cast(column.type)))
        elif what == "DROP" and rest[0].up in ("CONSTRAINT", "PRIMARY", "FOREIGN"):
            name = "" if rest[0].up == "PRIMARY" else name_of(rest[-1])
            table.primary = [] if rest[0].up == "PRIMARY" else table.primary
            table.unique = [u for u in table.unique if not name or u[0] != name]
            table.checks = [c for c in table.checks if not name or c[0] != name]
            table.foreign = [f for f in table.foreign if not name or f.name != name]
        elif what == "DROP":
            k, quiet = self._if(rest, 0)
            name = name_of(rest[k])
            if quiet and name not in [c.lower() for c in table.names]:
                return
            column = table.column(name)
            if any(column.name in key for key in table.keys()):
                raise SqlError(f"a key uses {column.name}")
            table.columns.remove(column)
            catalog.write(table, rows.drop(column.name))
        elif what == "RENAME":
            if rest[0].up in ("TO", "AS"):
                new = name_of(rest[1])
                del catalog.state.tables[table.name]
                self.spark.catalog.dropTempView(table.name)
                for child, fk in catalog.children(table):
                    fk.table = new
                table.name = new
                catalog.state.tables[new] = table
                catalog.publish(table)
            else:
                self._rename(table, rows, name_of(rest[0]), name_of(rest[2]))
        elif what in ("MODIFY", "CHANGE"):
            old = table.column(name_of(rest[0]))
            if what == "CHANGE":
                self._rename(table, rows, old.name, name_of(rest[1]))
                rest, rows = rest[1:], catalog.read(table)
            at = table.columns.index(old)
            new = self._column(table, rest)
            table.columns.pop()
            table.columns[at] = new
            catalog.check_rows(table, rows, self.express)
            catalog.write(table, rows)
        elif what == "ALTER":
            column = table.column(name_of(rest[0]))
            action = text_of(rest[1:3]).upper()
            if action == "SET DEFAULT":
                column.default = text_of(rest[3:])
            elif action == "DROP DEFAULT":
                column.default = None
            else:
                column.nullable = action != "SET NOT"
                try:
                    catalog.check_rows(table, rows, self.express)
                except SqlError:
                    column.nullable = True
                    raise
        else:
            raise SqlError(f"unknown ALTER TABLE {what}")

    def _rename(self, table: Table, rows: DataFrame, old: str, new: str) -> None:
        column = table.column(old)
        swap = lambda names: [new if c == column.name else c for c in names]
        table.primary, table.unique = swap(table.primary), [(n, swap(u)) for n, u in table.unique]
        for fk in table.foreign:
            fk.columns = swap(fk.columns)
        for _, fk in self.catalog.children(table):
            fk.targets = swap(fk.targets)
        rows = rows.withColumnRenamed(column.name, new)
        column.name = new
        self.catalog.write(table, rows)

    def _reindex(self, items: list[Item]) -> None:
        """Indexes are definitions only."""

    def _analyze(self, items: list[Item]) -> DataFrame:
        """Row count and per column nulls and distinct values of a table."""
        table = self.catalog.table(name_of(items[-1]))
        rows = self.catalog.read(table)
        stats = [F.count("*").alias("rows")]
        for c in table.names:
            stats += [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"{c}_nulls"), F.approx_count_distinct(f"`{c}`").alias(f"{c}_distinct")]
        return rows.agg(*stats)

    # Sessions and privileges ------------------------------------------------------------------------

    def _set(self, items: list[Item]) -> None:
        text = [x.up for x in items]
        if text[1] == "ROLE":
            self.role = name_of(items[2])
        elif text[1] in ("SCHEMA", "CATALOG", "DATABASE"):
            self.spark.sql(f"USE {name_of(items[2]) if items[2].kind != 'string' else items[2].text[1:-1]}")
        elif text[1] == "NAMES":
            self.variables["@@character_set"] = text_of(items[2:3])
        elif text[1:3] == ["TIME", "ZONE"]:
            self.spark.sql(f"SET TIME ZONE {text_of(items[3:])}")
        elif text[1] == "TRANSACTION":
            return
        else:
            for part in split(items[1:]):
                part = part[1:] if part[0].up in ("SESSION", "GLOBAL") else part
                at = next(k for k, x in enumerate(part) if x.up in ("=", ":", "TO"))
                value = part[at + 1 :] if part[at].up != ":" else part[at + 2 :]
                name = part[0].text.lower()
                self._assign(name if name.startswith("@") or self._locals is not None else f"@@{name}", literal(self.value(value)))

    _locals: dict[str, str] | None = None

    def _assign(self, name: str, value: str) -> None:
        if self._locals is not None and name in self._locals:
            self._locals[name] = value
        else:
            self.variables[name if name.startswith("@") else f"@{name}"] = value

    def value(self, items: list[Item]):
        """One value of an expression, routine variables put in."""
        return self.spark.sql(f"SELECT {Rewriter(self.variables).text(self.bind(items))}").first()[0]

    def bind(self, items: list[Item]) -> list[Item]:
        """Routine variables as their values."""
        if not self._locals:
            return items
        out: list[Item] = []
        for k, x in enumerate(items):
            dotted = (k and items[k - 1].up == ".") or (k + 1 < len(items) and items[k + 1].up == ".")
            if isinstance(x, Group):
                out.append(Group(self.bind(x.items)))
            elif x.kind == "word" and x.text.lower() in self._locals and not dotted:
                out += parse(self._locals[x.text.lower()])
            else:
                out.append(x)
        return out

    def _grant(self, items: list[Item], take: bool = False) -> None:
        on = next(k for k, x in enumerate(items) if x.up == "ON")
        to = next(k for k, x in enumerate(items) if x.up in ("TO", "FROM"))
        k = on + 2 if items[on + 1].up == "TABLE" else on + 1
        rights = [p[0].up for p in split(items[1:on])]
        rights = ["SELECT", "INSERT", "UPDATE", "DELETE"] if rights == ["ALL"] else rights
        for role in split([x for x in items[to + 1 :] if x.up not in ("CASCADE", "RESTRICT")]):
            for right in rights:
                grant = (name_of(role[0]), right, name_of(items[k]))
                (self.catalog.state.grants.discard if take else self.catalog.state.grants.add)(grant)

    def _revoke(self, items: list[Item]) -> None:
        self._grant(items, take=True)

    def _allow(self, right: str, table: str) -> None:
        if self.secure and self.role != "admin" and not {(self.role, right, table), ("public", right, table)} & self.catalog.state.grants:
            raise PrivilegeError(f"{self.role} may not {right} {table}")

    def _allow_reads(self, items: list[Item]) -> None:
        if self.secure and self.role != "admin":
            for x in _flat(items):
                name = x.text.strip('`"').lower() if x.kind in ("word", "quoted") else ""
                if name in self.catalog.state.tables or name in self.catalog.state.views:
                    self._allow("SELECT", name)

    def _show(self, items: list[Item]) -> DataFrame:
        what, state = items[1].up, self.catalog.state
        if what == "TABLES":
            return self.spark.createDataFrame([(n,) for n in sorted(state.tables)], "table string")
        if what in ("COLUMNS", "FIELDS"):
            return self._describe([items[0], items[3]])
        if what in ("INDEX", "INDEXES", "KEYS"):
            return self.spark.createDataFrame([(n, t, ",".join(c), k) for n, (t, c, k) in sorted(state.indexes.items()) if t == name_of(items[3])], "name string, table string, columns string, kind string")
        if what == "CREATE":
            return self.spark.createDataFrame([(ddl(self.catalog.table(name_of(items[3]))),)], "statement string")
        return self.spark.sql(text_of(items))

    def _describe(self, items: list[Item]) -> DataFrame:
        table = self.catalog.table(name_of(items[-1]))
        return self.spark.createDataFrame([(c.name, c.type.lower(), c.nullable and c.name not in table.primary, c.default) for c in table.columns], "column string, type string, nullable boolean, default string")

    _desc = _describe

    # Transactions -------------------------------------------------------------------------------

    def _begin(self, items: list[Item]) -> None:
        self.catalog.begin()

    def _start(self, items: list[Item]) -> None:
        self.catalog.begin()

    def _commit(self, items: list[Item]) -> None:
        self.catalog.commit()

    def _rollback(self, items: list[Item]) -> None:
        self.catalog.rollback(name_of(items[-1]) if any(x.up == "TO" for x in items) else None)

    def _savepoint(self, items: list[Item]) -> None:
        self.catalog.savepoint(name_of(items[1]))

    def _release(self, items: list[Item]) -> None:
        self.catalog.release(name_of(items[-1]))

    # Changes ------------------------------------------------------------------------------------

    def _atomic(self, run) -> DataFrame:
        """A statement that fails leaves every table as it was."""
        import copy

        before = copy.deepcopy(self.catalog.state)
        try:
            return self._affected(run())
        except Exception:
            now, self.catalog.state = self.catalog.state, before
            self.catalog.republish(now)
            raise

    def _insert(self, items: list[Item], conflict: str = "error") -> DataFrame:
        items = self.bind(items)
        k = 1
        if items[k].up == "IGNORE":
            conflict, k = "ignore", k + 1
        elif items[k].up == "OR":
            conflict, k = items[k + 1].up.lower(), k + 2
        k += items[k].up == "INTO"
        table = self.catalog.table(name_of(items[k]))
        self._allow("INSERT", table.name)
        k += 1
        columns = table.names
        if isinstance(items[k], Group) and (not items[k].items or items[k].items[0].up not in ("SELECT", "WITH")):
            columns, k = [name_of(c[0]) for c in split(items[k].items)], k + 1
        updates: dict[str, str] = {}
        end = next((j for j in range(k, len(items)) if items[j].up == "ON" and items[j + 1].up == "DUPLICATE"), len(items))
        if end < len(items):
            conflict = "update"
            for part in split(items[end + 4 :]):
                updates[name_of(part[0])] = self.express(text_of(_values_of(part[2:])))
        source = items[k:end]
        if source[0].up == "DEFAULT":
            given, columns = self.spark.range(1).select(), []
        elif source[0].up == "VALUES":
            given = self._values(table, columns, split(source[1:]))
        else:
            given = self.query(source)
        return self._atomic(lambda: self.writer.insert(table, self.writer.complete(table, given, columns), conflict, updates))

    def _values(self, table: Table, columns: list[str], rows: list[list[Item]]) -> DataFrame:
        out = []
        for r in rows:
            cells = split(r[0].items)
            if len(cells) != len(columns):
                raise SqlError(f"{len(columns)} columns and {len(cells)} values")
            texts = []
            for c, cell in zip(columns, cells, strict=True):
                text = text_of(cell)
                text = (table.column(c).default or "NULL") if text.upper() == "DEFAULT" else text
                texts.append(f"CAST({self.express(text)} AS {table.column(c).type})")
            out.append(f"SELECT {', '.join(f'{t} AS c{i}' for i, t in enumerate(texts))}")
        return self.spark.sql(" UNION ALL ".join(out)).coalesce(1)  # literal rows, kept in order

    def _replace(self, items: list[Item]) -> DataFrame:
        return self._insert(items, "replace")

    def _update(self, items: list[Item]) -> DataFrame:
        items = self.bind(items)
        table = self.catalog.table(name_of(items[1]))
        self._allow("UPDATE", table.name)
        at = next(k for k, x in enumerate(items) if x.up == "SET")
        alias = name_of(items[at - 1]) if at > 2 else None
        where = next((k for k, x in enumerate(items) if x.up == "WHERE"), None)
        sets = {}
        for part in split(items[at + 1 : where]):
            eq = next(k for k, x in enumerate(part) if x.up == "=")
            sets[name_of(part[eq - 1])] = text_of(part[eq + 1 :])
        condition = text_of(items[where + 1 :]) if where is not None else None
        return self._atomic(lambda: self.writer.update(table, sets, condition, alias))

    def _delete(self, items: list[Item]) -> DataFrame:
        items = self.bind(items)
        table = self.catalog.table(name_of(items[2]))
        self._allow("DELETE", table.name)
        where = next((k for k, x in enumerate(items) if x.up == "WHERE"), None)
        alias = name_of(items[(where or len(items)) - 1]) if (where or len(items)) > 3 else None
        condition = text_of(items[where + 1 :]) if where is not None else None
        return self._atomic(lambda: self.writer.delete(table, condition, alias))

    def _truncate(self, items: list[Item]) -> None:
        k = 1 + (items[1].up == "TABLE")
        k, quiet = self._if(items, k)
        cascade = items[-1].up == "CASCADE"
        for part in split([x for x in items[k:] if x.up not in ("CASCADE", "RESTRICT")]):
            name = name_of(part[0])
            if quiet and name not in self.catalog.state.tables:
                continue
            self._allow("DELETE", name)
            self.writer.truncate(self.catalog.table(name), cascade)

    def _call(self, items: list[Item]) -> DataFrame | None:
        from lathe import routines

        return routines.call(self, items)

    # Triggers -----------------------------------------------------------------------------------

    def _fire(self, table: Table, timing: str, event: str, old: DataFrame | None, new: DataFrame | None, changed: set[str] | None = None) -> DataFrame | None:
        """Run the table's triggers over the rows of a statement; a BEFORE row trigger may SET NEW columns.

        A row trigger's INSERT ... VALUES with NEW and OLD runs once for all rows as INSERT ... SELECT; other
        statements with NEW and OLD run row by row, for at most _ROWS rows of a statement (more is an error).
        """
        own = [t for t in self.catalog.state.triggers.values() if t.enabled and t.table == table.name and (t.timing, t.event) == (timing, event)]
        for t in own:
            if t.columns and changed is not None and not {c.lower() for c in changed} & set(t.columns):
                continue
            if self._depth >= _DEPTH:
                raise SqlError(f"triggers nest deeper than {_DEPTH}")
            self._depth += 1
            try:
                for s in t.body:
                    new = self._fire_one(table, t, s, old, new)
            finally:
                self._depth -= 1
        return new

    def _fire_one(self, table: Table, t: Trigger, s: list[Item], old: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
        refers = any(x.up in ("NEW", "OLD") for x in _flat(s))
        if not t.row or (not refers and t.when is None):
            times = 1 if not t.row else (new if new is not None else old).count()
            for _ in range(times):
                self.statement(s)
            return new
        parts = [d.select(*[F.col(f"`{c}`").alias(f"{p}_{c}") for c in table.names], *(["_row"] if "_row" in d.columns else [])) for p, d in (("new", new), ("old", old)) if d is not None]
        rows = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "_row")
        view = f"trigger_rows_{self._depth}"
        self.catalog.temporary(rows).createOrReplaceTempView(view)
        named = lambda xs: parse(text_of(_transition(xs)))
        where = f" WHERE {self.express(text_of(named(parse(t.when))))}" if t.when else ""
        if s[0].up == "SET":
            target = name_of(s[3])
            value = self.express(text_of(named(s[5:])))
            when = self.express(text_of(named(parse(t.when)))) if t.when else "true"
            column = table.column(target)
            flat = self.spark.table(view).withColumn(f"new_{column.name}", F.expr(f"CASE WHEN {when} THEN {value} ELSE new_{column.name} END").cast(column.type))
            return flat.select(*[F.col(f"new_{c}").alias(c) for c in table.names], *(["_row"] if "_row" in flat.columns else []))
        at = next((k for k, x in enumerate(s) if x.up == "VALUES"), None) if s[0].up == "INSERT" else None
        if at is not None:
            for row in split(s[at + 1 :]):
                self.statement([*s[:at], *parse(f"SELECT {text_of(named(row[0].items))} FROM {view}{where}")])
            return new
        if not refers:
            for _ in range(self.spark.sql(f"SELECT * FROM {view}{where}").count()):
                self.statement(s)
            return new
        # Other statements see the rows that the ones before them have changed, so they run one after another.
        hits = self.spark.sql(f"SELECT * FROM {view}{where}").limit(_ROWS + 1).collect()
        if len(hits) > _ROWS:
            raise SqlError(f"a row trigger's {s[0].up} runs for at most {_ROWS} rows of a statement")
        for r in sorted(hits, key=lambda r: r["_row"]) if hits and "_row" in hits[0] else hits:
            self.statement(_transition(s, {c: parse(literal(r[c])) for c in r.asDict() if c != "_row"}))
        return new

    # Persistence --------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        from lathe.sources.dump import save

        save(self, path)

    def load(self, path: str) -> None:
        from lathe.sources.dump import load

        load(self, path)


def ddl(table: Table) -> str:
    """CREATE TABLE text of a table."""
    parts = [f"{c.name} {c.type.upper()}{'' if c.nullable else ' NOT NULL'}{f' DEFAULT {c.default}' if c.default is not None else ''}{' AUTO_INCREMENT' if c.auto else ''}" for c in table.columns]
    parts += [f"PRIMARY KEY ({', '.join(table.primary)})"] if table.primary else []
    parts += [f"{f'CONSTRAINT {n} ' if n else ''}UNIQUE ({', '.join(u)})" for n, u in table.unique]
    parts += [f"{f'CONSTRAINT {n} ' if n else ''}CHECK ({c})" for n, c in table.checks]
    parts += [f"{f'CONSTRAINT {f.name} ' if f.name else ''}FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.table} ({', '.join(f.targets)}) ON DELETE {f.on_delete} ON UPDATE {f.on_update}" for f in table.foreign]
    return f"CREATE TABLE {table.name} ({', '.join(parts)})"


def literal(value) -> str:
    """SQL text of a Python value."""
    import datetime
    import decimal

    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value}'"
    return "'" + str(value).replace("'", "''") + "'"


def _flat(items: list[Item]):
    for x in items:
        if isinstance(x, Group):
            yield from _flat(x.items)
        else:
            yield x


def _transition(items: list[Item], values: dict[str, list[Item]] | None = None) -> list[Item]:
    """NEW.c -> new_c, OLD.c -> old_c, or their values."""
    out: list[Item] = []
    known = {c.lower(): v for c, v in (values or {}).items()}
    k = 0
    while k < len(items):
        x = items[k]
        if x.up in ("NEW", "OLD") and k + 2 < len(items) and items[k + 1].up == ".":
            name = f"{x.up.lower()}_{name_of(items[k + 2])}"
            out.append(Group(known[name.lower()]) if values else Token("word", name))
            k += 3
        else:
            out.append(Group(_transition(x.items, values)) if isinstance(x, Group) else x)
            k += 1
    return out


def _values_of(items: list[Item]) -> list[Item]:
    """VALUES(c) in ON DUPLICATE KEY UPDATE -> the new row's column."""
    out: list[Item] = []
    k = 0
    while k < len(items):
        x = items[k]
        if x.up == "VALUES" and k + 1 < len(items) and isinstance(items[k + 1], Group):
            out.append(Token("quoted", f"`new_{name_of(items[k + 1].items[0])}`"))
            k += 2
        else:
            out.append(Group(_values_of(x.items)) if isinstance(x, Group) else x)
            k += 1
    return out
