"""The registered queries of the reference's operators: name -> (callable, oracle SQL).

Most are one text in the engine's dialect, rewritten and run by Spark over temporary views, with the DuckDB text of
the same rows beside it where the spelling differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathe.dialect import rewrite
from lathe.session import TABLES, register

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def sql(name: str, text: str, oracle: str | None = None, raw: bool = False) -> None:
    """Register a text; the oracle is the same text unless given. raw: Spark SQL that is not rewritten."""
    spark_text = text if raw else rewrite(text)
    words = set(re.findall(r"\w+", text.lower()))
    used = [t for t in TABLES if t in words]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *used)
        return spark.sql(spark_text)

    add(name, run, text if oracle is None else oracle)


def add(name: str, query: Query, oracle: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if oracle:
        _ORACLES[name] = oracle


def _load() -> None:
    from lathe.plans import covered, functions, relational, stateful, tpch  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
