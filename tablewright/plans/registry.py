"""Catalogue of named queries: Spark callable plus (optional) DuckDB twin.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
supplied tables (or data Spark derives from them).  The SQL twin runs in
DuckDB over the same parquet tables registered as views.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ids: tuple = ()):
    def deco(fn):
        old = QUERIES.get(name)
        if old is not None and (old.fn.__module__, old.fn.__qualname__) != (fn.__module__, fn.__qualname__):
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql.strip() if sql else None, ids)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from . import (q_cleaning, q_charts, q_clustering, q_functions, q_models,  # noqa: F401
                   q_profile, q_views)
    return QUERIES
