"""python -m lathe.cli [-c SQL] [-f FILE] [--format FORM] [--tables SF_DIR]: run statements, or read them line by line."""

from __future__ import annotations

import argparse
import sys
import time

from lathe.engine import Engine
from lathe.lexer import SqlError
from lathe.session import register, session
from lathe.sources import files


def meta(engine: Engine, line: str) -> str:
    r"""Backslash commands: \dt \d TABLE \dv \ds \di \du \df \copy TABLE TO|FROM 'FILE' \save PATH \load PATH."""
    command, *rest = line.split()
    state = engine.catalog.state
    if command == "\\dt":
        return "\n".join(sorted(state.tables))
    if command == "\\d" and rest:
        return files.render(engine.sql(f"DESCRIBE {rest[0]}"))
    if command == "\\d":
        return "\n".join(sorted([*state.tables, *state.views]))
    if command == "\\dv":
        return "\n".join(sorted(state.views))
    if command == "\\ds":
        return files.render(engine.spark.sql("SHOW DATABASES"))
    if command == "\\di":
        return "\n".join(f"{n} on {t} ({', '.join(c)})" for n, (t, c, _) in sorted(state.indexes.items()))
    if command == "\\du":
        return "\n".join(sorted(state.roles))
    if command == "\\df":
        return "\n".join(sorted([*state.functions, *state.procedures]))
    if command in ("\\save", "\\load"):
        getattr(engine, command[1:])(rest[0])
        return "done"
    if command == "\\copy":
        name, way, path = rest[0], rest[1].upper(), rest[2].strip("'")
        table, is_json = engine.catalog.table(name), path.endswith(".json")
        if way == "TO":
            (files.write_json if is_json else files.write_csv)(engine.catalog.read(table), path)
        else:
            schema = ", ".join(f"`{c.name}` {c.type}" for c in table.columns)
            rows = (files.read_json if is_json else files.read_csv)(engine.spark, path, schema)
            engine.writer.insert(table, engine.writer.complete(table, rows, table.names))
        return "done"
    raise SqlError(f"unknown command {command}")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-c", "--command")
    p.add_argument("-f", "--file")
    p.add_argument("--format", default="table")
    p.add_argument("--tables", help="folder whose Parquet tables are registered")
    a = p.parse_args(args)
    engine, timing = Engine(session()), False
    if a.tables:
        register(engine.spark, a.tables)
    if a.command or a.file:
        with open(a.file) if a.file else _text(a.command) as f:
            result = engine.sql(f.read())
        if result is not None:
            sys.stdout.writelines(files.pieces(result, a.format))
            print()
        return 0
    text = ""
    for line in sys.stdin:
        if not text and line.strip() in ("\\q", "quit", "exit"):
            break
        if not text and line.startswith("\\"):
            if line.strip() == "\\timing":
                timing = not timing
            else:
                print(_tried(lambda line=line: meta(engine, line)))
            continue
        text += line
        if ";" in line:
            began = time.time()
            print(_tried(lambda text=text: files.render(r, a.format) if (r := engine.sql(text)) is not None else "OK"))
            if timing:
                print(f"{time.time() - began:.3f} s")
            text = ""
    return 0


def _tried(run) -> str:
    try:
        return run()
    except Exception as e:
        return f"error: {e}"


def _text(s: str):
    import io

    return io.StringIO(s)


if __name__ == "__main__":
    sys.exit(main())
