"""INSERT, UPDATE, DELETE and TRUNCATE as set operations that make a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.catalog import Catalog, ConstraintError, ForeignKey, Table
from lathe.lexer import SqlError


def q(name: str) -> str:
    return f"`{name}`"


class Writer:
    """Changes of one engine's tables. express: condition or expression text -> Spark SQL text."""

    def __init__(self, catalog: Catalog, express, fire=lambda *a: a[-1]):
        self.catalog, self.express, self.fire = catalog, express, fire

    # Insert -------------------------------------------------------------------------------------

    def complete(self, table: Table, given: DataFrame, columns: list[str]) -> DataFrame:
        """given's columns by position as the table's, typed; defaults and numbers for what is not given."""
        if len(given.columns) != len(columns):
            raise SqlError(f"{len(columns)} columns and {len(given.columns)} values")
        names = [table.column(c).name for c in columns]
        rows = given.toDF(*names)
        if any(c.auto for c in table.columns):
            rows = self.catalog.numbered(rows, "_number")
        exprs = []
        for c in table.columns:
            value = F.col(q(c.name)) if c.name in names else F.expr(self.express(c.default)) if c.default is not None else F.lit(None)
            if c.auto:
                value = F.coalesce(value, F.col("_number") + (table.next_id - 1))
            exprs.append(value.cast(c.type).alias(c.name))
        return rows.select(*exprs)

    def insert(self, table: Table, rows: DataFrame, on_conflict: str = "error", updates: dict[str, str] | None = None) -> int:
        """on_conflict: error, ignore, replace or update (with updates: column -> expression over old columns and VALUES(c))."""
        catalog = self.catalog
        rows = self.fire(table, "BEFORE", "INSERT", None, catalog.temporary(rows))
        path, rows = catalog.part(table, rows)
        n = rows.count()
        old = catalog.read(table)
        catalog.check_rows(table, rows, self.express)
        keys = table.keys()
        added = rows
        if on_conflict != "error" and keys:
            if on_conflict == "ignore":
                for key in keys:
                    first = Window.partitionBy(*map(q, key)).orderBy(F.monotonically_increasing_id())
                    has_null = F.greatest(*[F.col(q(c)).isNull().cast("int") for c in key]) == 1 if len(key) > 1 else F.col(q(key[0])).isNull()
                    added = added.withColumn("_n", F.row_number().over(first)).filter((F.col("_n") == 1) | has_null).drop("_n")
                    added = added.join(old.select(*key), key, "left_anti").select(*table.names)
                path, added = catalog.part(table, added)
                n = added.count()
            elif on_conflict == "replace":
                for key in keys:
                    last = Window.partitionBy(*map(q, key)).orderBy(F.monotonically_increasing_id().desc())
                    added = added.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
                    old = old.join(added.select(*key), key, "left_anti").select(*table.names)
                result = old.unionByName(added)
            else:
                result = self._upsert(table, old, rows, keys[0], updates or {})
        if on_conflict in ("error", "ignore") or not keys:
            # Only new rows are written and checked; of the old ones only key columns are read.
            catalog.check_keys(table, added, old)
            catalog.check_references(table, added, old)
            self._count_on(table, rows)
            catalog.append(table, path)
        else:
            result = catalog.temporary(result)
            catalog.check_keys(table, result)
            catalog.check_references(table, result)
            self._count_on(table, rows)
            catalog.write(table, result)
        self.fire(table, "AFTER", "INSERT", None, added)
        return n

    @staticmethod
    def _count_on(table: Table, rows: DataFrame) -> None:
        for c in table.columns:
            if c.auto:
                table.next_id = max(table.next_id, (rows.agg(F.max(q(c.name))).first()[0] or 0) + 1)

    def _upsert(self, table: Table, old: DataFrame, rows: DataFrame, key: list[str], updates: dict[str, str]) -> DataFrame:
        new = rows.select(*[F.col(q(c)).alias(f"new_{c}") for c in table.names])
        on = None
        for c in key:
            same = F.col(q(c)) == F.col(q(f"new_{c}"))
            on = same if on is None else on & same
        both = old.join(new, on, "full")
        hit, fresh = F.col(q(f"new_{key[0]}")).isNotNull() & F.col(q(key[0])).isNotNull(), F.col(q(key[0])).isNull()
        out = []
        for c in table.columns:
            text = updates.get(c.name.lower())
            changed = F.expr(text) if text is not None else F.col(q(c.name))
            out.append(F.when(hit, changed).when(fresh, F.col(q(f"new_{c.name}"))).otherwise(F.col(q(c.name))).cast(c.type).alias(c.name))
        return both.select(*out)

    # Update and delete --------------------------------------------------------------------------

    def _flagged(self, table: Table, alias: str | None, where: str | None, extra: list[str]) -> DataFrame:
        """Rows of the table with _hit and the given expressions."""
        condition = f"coalesce(CAST(({self.express(where)}) AS BOOLEAN), false)" if where else "true"
        return self.catalog.spark.sql(f"SELECT {alias or table.name}.*, {', '.join([f'{condition} AS _hit', *extra])} FROM {table.name} {f'AS {alias}' if alias else ''}")

    def update(self, table: Table, sets: dict[str, str], where: str | None = None, alias: str | None = None) -> int:
        catalog = self.catalog
        extra = [f"CAST({self._value(table, c, e)} AS {table.column(c).type}) AS `_set_{table.column(c).name}`" for c, e in sets.items()]
        # Old and new rows are told apart by a number that is written with them.
        rows = catalog.temporary(self._flagged(table, alias, where, [*extra, "monotonically_increasing_id() AS _row"]))
        hits = rows.filter("_hit")
        n = hits.count()
        if not n:
            return 0
        changed_columns = {table.column(c).name for c in sets}
        new_of = lambda c: F.col(q(f"_set_{c}")) if c in changed_columns else F.col(q(c))
        old_rows = hits.select(*table.names, "_row")
        new_rows = hits.select(*[new_of(c).alias(c) for c in table.names], "_row")
        fired = self.fire(table, "BEFORE", "UPDATE", old_rows, new_rows, changed_columns)
        if fired is not new_rows:
            new_rows = catalog.temporary(fired)
        catalog.check_rows(table, new_rows, self.express)
        result = catalog.temporary(rows.filter("NOT _hit").select(*table.names).unionByName(new_rows.select(*table.names)))
        catalog.check_keys(table, result)
        pairs = hits.select(*[F.col(q(c)).alias(f"old_{c}") for c in table.names], *[new_of(c).alias(f"new_{c}") for c in table.names])
        for child, fk in catalog.children(table):
            if any(table.column(t).name in changed_columns for t in fk.targets):
                self._follow(table, child, fk, pairs, fk.on_update, update=True)
        catalog.write(table, result)
        catalog.check_references(table, catalog.read(table))
        self.fire(table, "AFTER", "UPDATE", old_rows, new_rows, changed_columns)
        return n

    def _value(self, table: Table, column: str, text: str) -> str:
        if text.strip().upper() == "DEFAULT":
            text = table.column(column).default or "NULL"
        return self.express(text)

    def delete(self, table: Table, where: str | None = None, alias: str | None = None) -> int:
        rows = self.catalog.temporary(self._flagged(table, alias, where, []))
        return self._remove(table, rows.filter("_hit").select(*table.names), rows.filter("NOT _hit").select(*table.names))

    def _remove(self, table: Table, gone: DataFrame, rest: DataFrame, depth: int = 0) -> int:
        """Write rest, then act on the rows that refer to gone. Cascades end because each level has fewer rows."""
        catalog = self.catalog
        n = gone.count()
        if not n:
            return 0
        self.fire(table, "BEFORE", "DELETE", gone, None)
        children = catalog.children(table)
        pairs = gone.select(*[F.col(q(c)).alias(f"old_{c}") for c in table.names])
        for child, fk in children:
            if fk.on_delete in ("NO ACTION", "RESTRICT"):
                left = rest if child is table else catalog.read(child)
                if not self._referring(left, table, fk, pairs).isEmpty():
                    raise ConstraintError(f"rows of {child.name} refer to rows of {table.name} that are to go")
        catalog.write(table, rest)
        for child, fk in children:
            if fk.on_delete not in ("NO ACTION", "RESTRICT"):
                self._follow(table, child, fk, pairs, fk.on_delete, update=False)
        self.fire(table, "AFTER", "DELETE", gone, None)
        return n

    def _referring(self, rows: DataFrame, table: Table, fk: ForeignKey, pairs: DataFrame, how: str = "left_semi") -> DataFrame:
        on = None
        for c, t in zip(fk.columns, fk.targets, strict=True):
            same = F.col(q(c)) == F.col(q(f"old_{table.column(t).name}"))
            on = same if on is None else on & same
        return rows.join(pairs, on, how)

    def _follow(self, table: Table, child: Table, fk: ForeignKey, pairs: DataFrame, action: str, update: bool) -> None:
        catalog = self.catalog
        current = catalog.read(child)
        hit = catalog.temporary(self._referring(current, table, fk, pairs, "left_semi" if not update else "inner"))
        if update and not hit.isEmpty():
            moved = None
            for t in fk.targets:
                name = table.column(t).name
                one = ~F.col(q(f"old_{name}")).eqNullSafe(F.col(q(f"new_{name}")))
                moved = one if moved is None else moved | one
            hit = hit.filter(moved)
        if hit.isEmpty():
            return
        if action in ("NO ACTION", "RESTRICT"):
            raise ConstraintError(f"rows of {child.name} refer to rows of {table.name} whose key is to change")
        own = hit.select(*child.names)
        rest = catalog.temporary(self._referring(current, table, fk, pairs.filter(moved) if update else pairs, "left_anti"))
        if action == "CASCADE" and not update:
            self._remove(child, own, rest)
            return
        changed = {}
        for c, t in zip(fk.columns, fk.targets, strict=True):
            column = child.column(c)
            changed[column.name] = F.col(q(f"new_{table.column(t).name}")) if action == "CASCADE" else F.expr(self.express(column.default or "NULL")) if action == "SET DEFAULT" else F.lit(None)
        new = hit.select(*[(changed.get(c.name, F.col(q(c.name)))).cast(c.type).alias(c.name) for c in child.columns])
        catalog.check_rows(child, new, self.express)
        catalog.write(child, catalog.temporary(rest.unionByName(new)))

    def truncate(self, table: Table, cascade: bool = False) -> None:
        for child, _ in self.catalog.children(table):
            if child is not table:
                if not cascade:
                    raise ConstraintError(f"{child.name} refers to {table.name}")
                self.truncate(child, True)
        self.catalog.write(table, self.catalog.spark.createDataFrame([], self.catalog.schema(table)))
        table.next_id = 1
