"""Decorator that registers a query with its comparison SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.session import tune
from tidebook.tables import Tables, oracle_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = ("reports", "sources", "projections", "joins", "aggregates", "windows", "ordering", "scalars", "models", "web", "streams")


def query(name: str, sql: str | None = None):
    """Register ``f(t: Tables) -> DataFrame``; without ``sql`` the query is checked by tests only."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = oracle_text(sql)
        return f

    return register


def dbl(column: str | Column, digits: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits)


def as_double(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Report columns as rounded doubles (default: every decimal and double column)."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() in ("decimal", "double", "float")]
    return df.withColumns({c: dbl(c, digits) for c in names})


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tidebook.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
