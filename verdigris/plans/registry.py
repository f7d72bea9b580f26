"""Every registered query with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.plans.fixtures import Tables, oracle
from verdigris.sources.tables import shared_folder

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("records", "corpus", "merges", "hive", "reports", "texts", "money", "streams", "sources", "flows")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables as the query of a name; sql is its result in DuckDB, <x> being table or view x."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered already")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = oracle(sql)
        return f

    return add


def scratch(t: Tables) -> str:
    """A new folder in the cluster's shared one."""
    return shared_folder(t.spark, "streams")


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"verdigris.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
