"""Persisted intermediates.

Operators persist an intermediate when several jobs must read it (or read it
identically).  Results are lazy, so those intermediates cannot be released
inside the operator; they are registered here and ``release_cached()`` frees
them once the caller has consumed its results.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_HELD: list[DataFrame] = []


def hold(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    out = df.persist(level)
    _HELD.append(out)
    return out


def release(df: DataFrame) -> None:
    df.unpersist()
    if any(d is df for d in _HELD):
        _HELD[:] = [d for d in _HELD if d is not df]


def release_cached() -> int:
    """Unpersist every intermediate held by the operators; returns how many."""
    n = len(_HELD)
    for d in _HELD:
        d.unpersist()
    _HELD.clear()
    return n


def spread(df: DataFrame, n_rows: int, rows: int = 100_000) -> DataFrame:
    """``df`` dealt out to partitions of at most about ``rows`` rows: a file of one large row group, or a small file of
    many narrow rows, is read by a single task, and so is all that is made of its rows."""
    return df.repartition(math.ceil(n_rows / rows)) if n_rows > rows else df
