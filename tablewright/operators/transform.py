"""User-defined computation on the active table.

The reference runs a pandas snippet on an in-memory copy.  Here the same
extension point is a function over a DataFrame (``transform``), a pandas
function over Arrow batches of each partition (``map_batches``), a
two-phase pandas aggregation per group that stays skew safe
(``grouped_pandas``), or SQL over the active table (``sql``).  The
caller's table is never mutated: every call returns a new DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dataset import change_status, compare


def transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """G1: run a DataFrame -> DataFrame function."""
    out = df.transform(fn)
    if not isinstance(out, DataFrame):
        raise TypeError("the function must return a DataFrame")
    return out


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """Pandas function applied to each Arrow batch of every partition
    (``fn(pandas.DataFrame) -> pandas.DataFrame``, row-wise logic)."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def grouped_pandas(df: DataFrame, keys: list[str], partial, combine, partial_schema, schema, merge=None,
                   held: int = 20_000) -> DataFrame:
    """Pandas aggregation per group from small mergeable states.

    ``partial(pdf)`` turns the rows of one key in one Arrow batch into a small
    state (one row, key columns included); ``merge(pdf)`` turns several states
    of a key into one and runs inside the tasks, so a key leaves a task as one
    row however many rows it has there; ``combine(pdf)`` turns a key's states
    (one for each task at most, or one for each batch without ``merge``) into
    its result.  A key that holds all rows therefore needs the memory of one
    batch.  A task keeps at most about ``held`` states and hands them on when
    it meets more keys.  NULL and NaN keys are groups like others."""
    def by_key(pdf: pd.DataFrame, fn) -> pd.DataFrame:
        return pd.concat([fn(rows) for _, rows in pdf.groupby(keys, dropna=False, sort=False)], ignore_index=True)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0
        for pdf in batches:
            if len(pdf):
                waiting.append(by_key(pdf, partial))
                n += len(waiting[-1])
            if n > held:
                own = pd.concat(waiting, ignore_index=True)
                own = by_key(own, merge) if merge else own
                waiting, n = ([own], len(own)) if merge and len(own) <= held // 2 else ([], 0)
                if not waiting:
                    yield own
        if waiting:
            own = pd.concat(waiting, ignore_index=True)
            yield by_key(own, merge) if merge else own

    return df.mapInPandas(states, partial_schema).groupBy(*keys).applyInPandas(combine, schema)


def sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """SQL over named DataFrames, e.g. ``sql(spark, "select * from {df}", df=active)``."""
    return spark.sql(query, **frames)


def run_user_code(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str, DataFrame]:
    """G1 + G5: result, status ('changed' | 'unchanged' | 'created') and the
    (side, n_rows) difference table."""
    out = transform(df, fn)
    return out, change_status(df, out), compare(df, out)
