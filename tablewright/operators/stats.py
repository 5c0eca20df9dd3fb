"""Fused column statistics.

One ``agg`` computes every per-column statistic of a kind (null counts,
moments) in a single scan.  Quantiles and modes need value-level work; both
stay distributed: modes by a two-level group-by, exact quantiles by the
bracket selection of ``selection.py``.  ``method="approx"`` uses
``percentile_approx`` (bounded sketch per group) instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import dtype_of, is_numeric
from ..functions.columns import missing, named
from .selection import MOST, exact_quantiles


# Whole-stage code generation is switched off for an aggregate with more
# than ``spark.sql.codegen.maxFields`` (default 100) buffer fields, which makes
# it several times slower; wide aggregates are split into chunks below that.
AGG_FIELD_BUDGET = 96


def wide_agg(df: DataFrame, exprs: list, weights: list[int] | None = None) -> dict:
    """Run many single-row aggregate expressions; returns {alias: value}.

    Expressions are grouped into aggregates that stay below the session's
    ``spark.sql.codegen.maxFields`` (``weights`` estimates the buffer fields
    per expression)."""
    weights = weights or [1] * len(exprs)
    try:
        budget = int(df.sparkSession.conf.get("spark.sql.codegen.maxFields", "100")) - 4
    except (TypeError, ValueError):
        budget = AGG_FIELD_BUDGET
    budget = max(budget, 8)
    chunks, cur, used = [], [], 0
    for e, w in zip(exprs, weights):
        if cur and used + w > budget:
            chunks.append(cur)
            cur, used = [], 0
        cur.append(e)
        used += w
    if cur:
        chunks.append(cur)
    out = {}
    for chunk in chunks:
        out.update(df.agg(*chunk).collect()[0].asDict())
    return out


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), keep_missing: bool = False,
                value_type: str = "double") -> DataFrame:
    """Unpivot ``cols`` into ``(by..., column_name, v)``, missing values removed; see ``numbered_values`` for other names."""
    long = numbered_values(df, cols, by, value_type, keep_missing)
    return long.select(*_keys(by), _name(cols), "v").toDF(*by, "column_name", "v")


def _keys(by: Sequence[str]) -> list[str]:
    """Internal names of the group columns, so that a table's own names (``v``, ``value``, dots) never clash."""
    return [f"__tw_k{i}" for i in range(len(by))]


def numbered_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), value_type: str = "double", keep_missing: bool = False) -> DataFrame:
    """``(__tw_k0..., __tw_n, v)``; ``__tw_n`` is the number of the column in ``cols``."""
    if not cols:
        raise ValueError("no columns given")
    inner = [f"__tw_c{i}" for i in range(len(cols))]
    values = df.select(*(named(b).alias(k) for b, k in zip(by, _keys(by))), *(
        F.when(~missing(named(c), dtype_of(df, c)), named(c)).cast(value_type).alias(n) for c, n in zip(cols, inner)))
    if len(cols) == 1:
        long = values.select(*_keys(by), F.lit(0).alias("__tw_n"), F.col(inner[0]).alias("v"))
    else:
        long = values.unpivot(_keys(by), inner, "__tw_n", "v").withColumn("__tw_n", F.substring("__tw_n", 7, 9).cast("int"))
    return long if keep_missing else long.where(F.col("v").isNotNull())


def _name(cols: Sequence[str]):
    """Name of the column numbered ``__tw_n``."""
    return F.element_at(F.array(*(F.lit(c) for c in cols)), F.col("__tw_n") + 1).alias("column_name")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: (column, n_rows, n_missing), from one aggregate."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(missing(named(c), dtype_of(df, c))).alias(f"_m{i}") for i, c in enumerate(cols)]
    got = wide_agg(df, aggs)
    rows = [(c, int(got["_rows"]), int(got[f"_m{i}"])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column_name string, n_rows long, n_missing long")


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, count, mean, std, min, max): std is the sample one."""
    found = numbered_values(df, cols, by).groupBy(*_keys(by), "__tw_n").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    return found.select(*_keys(by), _name(cols), "count", "mean", "std", "min", "max").toDF(*by, "column_name", "count", "mean", "std", "min", "max")


def _quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], method: str,
               accuracy: int, most: int) -> DataFrame:
    """``(__tw_k0..., __tw_n, i, value)``."""
    probs = [float(p) for p in probs]
    keys = [*_keys(by), "__tw_n"]
    long = numbered_values(df, cols, by)
    if method == "approx":
        q = long.groupBy(*keys).agg(F.percentile_approx("v", probs, accuracy).alias("q"))
        return q.select(*keys, F.posexplode("q").alias("i", "value"))
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    return exact_quantiles(long, keys, probs, accuracy, most)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              method: str = "exact", accuracy: int = 10000, most: int = MOST) -> DataFrame:
    """Linear-interpolated quantiles ``(by..., column_name, prob, value)``.

    ``exact`` matches numpy/pandas ``quantile`` and SQL ``percentile_cont``;
    ``approx`` uses ``percentile_approx`` with the given accuracy.
    Groups with no non-missing value produce no rows.
    """
    q = _quantiles(df, cols, probs, by, method, accuracy, most)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    return q.select(*_keys(by), _name(cols), prob.alias("prob"), "value").toDF(*by, "column_name", "prob", "value")


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                   method: str = "exact", names: Sequence[str] | None = None, most: int = MOST) -> DataFrame:
    """Quantiles pivoted to one column per probability: (by..., column_name, q...)."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    q = _quantiles(df, cols, probs, by, method, 10000, most)
    aggs = [F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"__tw_q{i}") for i in range(len(probs))]
    wide = q.groupBy(*_keys(by), "__tw_n").agg(*aggs)
    return wide.select(*_keys(by), _name(cols), *(f"__tw_q{i}" for i in range(len(probs)))).toDF(*by, "column_name", *names)


def scalar_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     method: str = "exact", most: int = MOST) -> dict[str, list]:
    """Driver-side {column: [value per prob]} (one small row per column)."""
    if not cols:
        return {}
    out = {c: [None] * len(probs) for c in cols}
    for r in _quantiles(df, cols, probs, (), method, 10000, most).collect():
        out[cols[r["__tw_n"]]][r["i"]] = r["value"]
    return out


def modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-missing value per column; ties go to the smallest value.

    Two-level aggregation: counts per (column, value) with map-side combine,
    then ``min_by`` over (count desc, value) which also combines map-side, so
    no group's value set is ever held by one task.  Numeric columns are
    compared as doubles (integers as integers) and returned as text to share one output column.
    """
    by = list(by)
    num = [c for c in cols if is_numeric(dtype_of(df, c))]
    txt = [c for c in cols if c not in num]
    whole = [c for c in num if isinstance(dtype_of(df, c), T.IntegralType)]
    num = [c for c in num if c not in whole]
    parts = []
    for group, vtype in ((whole, "bigint"), (num, "double"), (txt, "string")):
        if not group:
            continue
        long = long_values(df, group, by, value_type=vtype)
        counts = long.groupBy(*by, "column_name", "v").agg(F.count(F.lit(1)).alias("_n"))
        best = counts.groupBy(*by, "column_name").agg(
            F.min_by(F.col("v"), F.struct((-F.col("_n")).alias("a"), F.col("v").alias("b"))).alias("mode"),
            F.max("_n").alias("mode_count"))
        parts.append(best.select(*by, "column_name", F.col("mode").cast("string").alias("mode"), "mode_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


