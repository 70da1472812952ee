"""CSV and JSON files in and out, and results as text."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header. With a schema nothing is inferred and the file is read once."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, array: bool = False) -> DataFrame:
    """JSON lines, or with array one JSON array per file."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_parquet(rows: DataFrame, path: str, compressed: bool = True) -> None:
    """The binary format; compressed with zstd or not at all."""
    rows.write.mode("overwrite").option("compression", "zstd" if compressed else "none").parquet(path)


def pieces(rows: DataFrame, form: str = "table") -> Iterator[str]:
    """All rows as text: table, json, csv, markdown or html. Rows come a partition at a time; only a table holds all, for its widths."""
    names, body = rows.columns, ([None if v is None else str(v) for v in r] for r in rows.toLocalIterator())
    if form == "json":
        between = "["
        for r in body:
            yield between + json.dumps(dict(zip(names, r, strict=True)))
            between = ", "
        yield "[]" if between == "[" else "]"
    elif form == "csv":
        quote = lambda v: "" if v is None else f'"{v.replace(chr(34), chr(34) * 2)}"' if any(c in v for c in ',"\n') else v
        yield ",".join(map(quote, names))
        for r in body:
            yield "\n" + ",".join(map(quote, r))
    elif form == "html":
        cells = lambda r, tag: "".join(f"<{tag}>{html.escape('NULL' if v is None else v)}</{tag}>" for v in r)
        yield f"<table><tr>{cells(names, 'th')}</tr>"
        for r in body:
            yield f"<tr>{cells(r, 'td')}</tr>"
        yield "</table>"
    elif form == "markdown":
        line = lambda r: f"| {' | '.join(('NULL' if v is None else v).replace('|', chr(92) + '|') for v in r)} |"
        yield line(names) + "\n" + line(["---"] * len(names))
        for r in body:
            yield "\n" + line(r)
    elif form == "table":
        shown = [["NULL" if v is None else v for v in r] for r in body]
        widths = [max(map(len, c)) for c in zip(names, *shown, strict=True)]
        line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
        yield "\n".join([line(names), "-+-".join("-" * w for w in widths), *map(line, shown), f"({len(shown)} rows)"])
    else:
        raise ValueError(f"unknown form {form}")


def render(rows: DataFrame, form: str = "table", limit: int | None = None) -> str:
    """All rows, or the first `limit`, for a terminal or page; see `pieces`."""
    return "".join(pieces(rows if limit is None else rows.limit(limit), form))
