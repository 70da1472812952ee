"""A whole database to a folder and back: DDL text, one Parquet table each, in order of references."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lathe.lexer import SqlError


def save(engine, path: str, form: str = "parquet") -> None:
    """schema (statements in the order in which they can be run) and data/<table> as Parquet or, with form json, JSON lines."""
    from lathe.engine import ddl

    state, done, statements = engine.catalog.state, [], []
    while len(done) < len(state.tables):
        ready = [t for n, t in sorted(state.tables.items()) if n not in done and all(fk.table.lower() in (*done, n) for fk in t.foreign)]
        if not ready:
            raise SqlError("tables refer to each other in a circle")
        for t in ready:
            done.append(t.name)
            statements.append(ddl(t))
            engine.catalog.read(t).write.mode("overwrite").format(form).save(f"{path}/data/{t.name}")
    info = {"form": form, "statements": statements, "tables": done, "next_ids": {n: t.next_id for n, t in state.tables.items()}, "views": state.views, "functions": state.functions}
    engine.spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def save_json(engine, path: str) -> None:
    """A whole database as JSON: definitions and rows."""
    save(engine, path, "json")


def load(engine, path: str) -> None:
    info = json.loads(engine.spark.read.text(f"{path}/schema", wholetext=True).first()[0])
    for statement in info["statements"]:
        engine.sql(statement)
    for name in info["tables"]:
        table = engine.catalog.table(name)
        rows = engine.spark.read.schema(engine.catalog.schema(table)).format(info.get("form", "parquet")).load(f"{path}/data/{name}")
        engine.catalog.write(table, rows.select(*[F.col(f"`{c}`") for c in table.names]))
        table.next_id = info["next_ids"][name]
    for name, text in info["views"].items():
        engine.spark.sql(text).createOrReplaceTempView(name)
        engine.catalog.state.views[name] = text
    for name, text in info["functions"].items():
        engine.spark.sql(text)
        engine.catalog.state.functions[name] = text
