"""Where queries of the repository operators register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.adapter import Graph, sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *tables: str):
    """Registers a function of a Graph under a name, with SQL over the graph tables that it names."""

    def register(f: Callable[[Graph], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            _SQL[name] = sql(oracle, *tables)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
