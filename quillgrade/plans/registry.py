"""Collects the queries of every operator module with their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with the SQL it must agree with."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return put


#: Modules that register queries when imported.
MODULES = ["access_queries", "report_queries", "grading_queries", "sequence_queries", "variant_queries", "state_queries", "geometry_queries", "text_queries"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quillgrade.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade every sheet and report each session's results."""
    return queries()["agg_09_grade"](spark, sf_dir)
