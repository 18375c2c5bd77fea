"""Named queries with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countygeo.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("collect", "scalars", "splitting", "labelling", "prediction", "evaluation", "vehicle", "runs", "stream", "files")


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the fixture views by name."""
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = with_views(sql, views)
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in _MODULES:
        importlib.import_module(f"countygeo.plans.{module}")
    return dict(_QUERIES), dict(_ORACLES)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded for comparison between engines; a negative zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def r6(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6) + F.lit(0.0)
