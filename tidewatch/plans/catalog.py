"""The query catalogue: name -> Spark query, name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans.bindings import VIEWS, Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
_MODULES = ("profile_queries", "cleaning_queries", "source_queries", "metric_queries", "feature_queries", "split_queries", "intel_queries",
            "model_queries")


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame``; views named in the SQL are bound in front of it."""
    def add(build: Callable[[Tables], DataFrame]):
        _QUERIES[name] = build
        if sql is not None:
            _ORACLE[name] = bind(sql)
        return build
    return add


def bind(sql: str) -> str:
    used = [v for v in VIEWS if v in sql]
    prefix = with_views(*used) if used else ""
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE " and prefix:
        return f"WITH RECURSIVE {prefix[5:]},\n{body[15:]}"
    if body[:5].upper() == "WITH " and prefix:
        return f"{prefix},\n{body[5:]}"
    return f"{prefix}\n{body}"


def _load() -> None:
    for module in _MODULES:
        import_module(f"tidewatch.plans.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bound(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: bound(build) for name, build in _QUERIES.items()}


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
