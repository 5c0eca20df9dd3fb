"""Cleaning: duplicates -> missing values -> type fixing -> outliers.

Every step reads its statistics in one fused aggregate (a driver action
that returns one small row per column) and then applies a lazy projection
or filter, so the data itself never leaves the executors.  Statistics become
literals in the next projection; the final plan is one scan with narrow
steps plus the de-duplication shuffle.

Options follow the reference: without options every step runs with its
default; with an options mapping, a step whose key is absent is off.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classes as C
from ..functions.columns import (DATE_FORMAT_SHAPES, DATE_FORMATS, clip, date_signatures, fill, is_whole, looks_like_date, missing, nan_to_null,
                                 parse_date_with, parse_number)
from . import stats
from .cache import hold, release
from .profile import duplicate_rows

LOG_SCHEMA = T.StructType([
    T.StructField("step_no", T.IntegerType(), False),
    T.StructField("step", T.StringType(), False),
    T.StructField("column_name", T.StringType(), True),
    T.StructField("n_affected", T.LongType(), True),
    T.StructField("lower", T.DoubleType(), True),
    T.StructField("upper", T.DoubleType(), True),
    T.StructField("detail", T.StringType(), True),
])

MISSING_METHODS = ("none", "drop_rows", "drop_cols", "mean", "median", "mode", "fill")


@dataclass
class CleanOptions:
    """Cleaning options; ``from_dict`` keeps the reference's rule that a
    partial mapping switches every unnamed step off."""

    drop_duplicates: bool = False
    handle_missing: str = "none"
    missing_numeric_fill: float | None = 0
    missing_categorical_fill: str = "Unknown"
    missing_col_drop_threshold: float = 0.5
    handle_outliers: Any = False          # False, "clip" or "remove"
    outlier_method: str = "iqr"           # "iqr" or "zscore"
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    fix_datatypes: bool = False
    outlier_exclude: tuple = ()           # numeric columns left out of outlier handling (ids, Q9)
    quantile_method: str = "exact"        # "exact" or "approx"
    extra: dict = field(default_factory=dict)

    @classmethod
    def default(cls) -> "CleanOptions":
        return cls(drop_duplicates=True, handle_missing="median", missing_numeric_fill=None,
                   missing_categorical_fill="Unknown", handle_outliers="clip", outlier_method="iqr",
                   iqr_multiplier=1.5, zscore_threshold=3, fix_datatypes=True)

    @classmethod
    def from_dict(cls, options: dict | None) -> "CleanOptions":
        if options is None:
            return cls.default()
        known = {f.name for f in fields(cls)} - {"extra"}
        kw = {k: v for k, v in options.items() if k in known}
        opts = cls(**kw)
        opts.extra = {k: v for k, v in options.items() if k not in known}
        opts.handle_missing = str(opts.handle_missing or "none").lower()
        if opts.handle_missing not in MISSING_METHODS:
            raise ValueError(f"unknown handle_missing {opts.handle_missing!r}")
        if isinstance(opts.handle_outliers, str):
            opts.handle_outliers = opts.handle_outliers.lower()
        opts.outlier_method = str(opts.outlier_method or "iqr").lower()
        return opts

    @classmethod
    def from_json(cls, text: str | None) -> "CleanOptions":
        if text is None or not text.strip():
            return cls.default()
        obj = json.loads(text)
        if not isinstance(obj, dict):
            raise ValueError("cleaning options must be a JSON object")
        return cls.from_dict(obj)


class _Log:
    def __init__(self):
        self.rows = []

    def add(self, step, column=None, n=None, lower=None, upper=None, detail=None):
        self.rows.append((len(self.rows) + 1, step, column, None if n is None else int(n),
                          None if lower is None else float(lower), None if upper is None else float(upper),
                          detail))

    def frame(self, spark):
        return spark.createDataFrame(self.rows, LOG_SCHEMA)


# ---------------------------------------------------------------- duplicates

def duplicate_count(df: DataFrame) -> int:
    """Rows after the first of each identical group (missing values compare equal)."""
    return int(duplicate_rows(df).collect()[0]["duplicate_rows"])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Identical rows once; NULL and NaN are equal, and NaN becomes NULL."""
    return df.select(*[nan_to_null(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).dropDuplicates()


# ---------------------------------------------------------------- missing values

def drop_missing_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value (NULL or NaN)."""
    cond = F.lit(True)
    for f in df.schema.fields:
        cond = cond & ~missing(F.col(f.name), f.dataType)
    return df.where(cond)


def sparse_columns(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """C3 decision: columns whose missing share is strictly above ``threshold``."""
    rows = stats.null_counts(df).collect()
    return [r["column_name"] for r in rows if r["n_rows"] > 0 and r["n_missing"] / r["n_rows"] > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def numeric_fill_values(df: DataFrame, cols: list[str], method: str, constant=0,
                        quantile_method: str = "exact") -> dict:
    """One fill value per numeric column (None when it cannot be computed)."""
    if not cols:
        return {}
    if method == "mean":
        row = stats.wide_agg(df, [F.avg(F.when(~missing(F.col(c), C.dtype_of(df, c)), F.col(c))).alias(c)
                                  for c in cols], [2] * len(cols))
        return {c: row[c] for c in cols}
    if method == "median":
        q = stats.scalar_quantiles(df, cols, [0.5], quantile_method)
        return {c: q[c][0] for c in cols}
    if method == "mode":
        m = {r["column_name"]: r["mode"] for r in stats.modes(df, cols).collect()}
        whole = {c for c in cols if isinstance(df.schema[c].dataType, T.IntegralType)}
        return {c: 0 if m.get(c) is None else int(m[c]) if c in whole else float(m[c]) for c in cols}
    if method == "fill":
        return {c: (0 if constant is None else constant) for c in cols}
    raise ValueError(method)


def categorical_fill_values(df: DataFrame, cols: list[str], method: str, constant="Unknown") -> dict:
    """Text fill value per column (mode, or the constant)."""
    if not cols:
        return {}
    if method == "mode":
        m = {r["column_name"]: r["mode"] for r in stats.modes(df, cols).collect()}
        return {c: (m.get(c) if m.get(c) is not None else "Unknown") for c in cols}
    return {c: constant for c in cols}


def apply_fills(df: DataFrame, values: dict) -> DataFrame:
    """Lazy projection replacing missing values.

    The column type is kept, except that an integer column becomes double
    when its fill value has a fraction.
    """
    out = []
    for f in df.schema.fields:
        v = values.get(f.name)
        if f.name in values and v is not None:
            widen = isinstance(f.dataType, T.IntegralType) and not float(v).is_integer()
            dtype = T.DoubleType() if widen else f.dataType
            out.append(fill(F.col(f.name).cast(dtype), F.lit(v).cast(dtype), dtype).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- type fixing

def detect_types(df: DataFrame, cols: list[str] | None = None, formats=DATE_FORMATS) -> DataFrame:
    """C11-C15 decision statistics for text columns, all from one aggregate.

    Output per column: n_rows, n_non_null, n_numeric, all_whole, looks_like_date,
    best_date_format, n_dates, and the decision ``target`` in
    {'integer', 'double', 'timestamp', None}.
    """
    cols = list(cols if cols is not None else C.string_columns(df))
    spark = df.sparkSession
    schema = ("column_name string, n_rows long, n_non_null long, n_numeric long, all_whole boolean, "
              "looks_like_date boolean, best_date_format string, n_dates long, target string")
    if not cols:
        return spark.createDataFrame([], schema)
    # the columns below one another: one scan and one narrow aggregate, however many they are.  Each value is read as a
    # number once; only where it is none it can look like a date (no number has a digit before - or /), and then only
    # the formats are tried that have its separators
    text = F.col("v")
    values = stats.numbered_values(df, cols, value_type="string", keep_missing=True).select("__tw_n", text, parse_number(text).alias("num"))
    like = F.col("num").isNull() & (F.contains(text, F.lit("-")) | F.contains(text, F.lit("/"))) & looks_like_date(text)
    values = values.select("__tw_n", text, "num", F.when(like, F.trim(text)).alias("dated"))
    num, dated = F.col("num"), F.col("dated")
    values = values.select("__tw_n", text, num, dated, F.translate(dated, "0123456789", "").alias("signature"))
    signed = lambda fmt: F.when(F.col("signature").isin(date_signatures(fmt)), dated) if fmt in DATE_FORMAT_SHAPES else dated
    aggs = [F.count(F.lit(1)).alias("n"), F.count(text).alias("nn"), F.count(num).alias("p"),
            F.coalesce(F.bool_and(is_whole(num) & (F.abs(num) < 9.2e18)), F.lit(True)).alias("w"),
            (F.count(dated) > 0).alias("d"),
            *(F.count(parse_date_with(signed(fmt), fmt)).alias(f"t{j}") for j, fmt in enumerate(formats))]
    found = {r["__tw_n"]: r for r in values.groupBy("__tw_n").agg(*aggs).collect()}
    none = {"n": 0, "nn": 0, "p": 0, "w": True, "d": False} | {f"t{j}": 0 for j in range(len(formats))}
    out = []
    for i, c in enumerate(cols):
        row = found.get(i, none)  # an empty table has no row
        n, nn, p, whole, date_like = row["n"], row["nn"], row["p"], row["w"], row["d"]
        counts = [row[f"t{j}"] for j in range(len(formats))]
        best = max(range(len(formats)), key=lambda j: (counts[j], -j))
        target = None
        if p > 0.8 * nn and (nn - p) < 0.1 * n:
            target = "integer" if whole else "double"
        elif date_like and counts[best] > 0.8 * nn:
            target = "timestamp"
        out.append((c, n, nn, p, bool(whole), bool(date_like), formats[best], counts[best], target))
    return spark.createDataFrame(out, schema)


def apply_types(df: DataFrame, decisions: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Lazy projection converting text columns: {column: (target, date_format)}."""
    out = []
    for c in df.columns:
        if c in decisions:
            target, fmt = decisions[c]
            if target == "integer":
                text = F.trim(F.col(c))  # integer text directly: a double holds only 53 bits
                exact = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
                out.append(F.coalesce(exact, parse_number(F.col(c)).cast("long")).alias(c))
            elif target == "double":
                out.append(parse_number(F.col(c)).alias(c))
            elif target == "timestamp":
                out.append(parse_date_with(F.col(c), fmt).alias(c))
            else:
                out.append(F.col(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fix_types(df: DataFrame) -> tuple[DataFrame, list]:
    rows = detect_types(df).collect()
    decisions = {r["column_name"]: (r["target"], r["best_date_format"]) for r in rows if r["target"]}
    return apply_types(df, decisions), [(c, t) for c, (t, _) in decisions.items()]


# ---------------------------------------------------------------- outliers

def outlier_bounds(df: DataFrame, cols: list[str], method: str = "iqr", multiplier: float = 1.5,
                   threshold: float = 3.0, quantile_method: str = "exact") -> dict:
    """{column: (lower, upper)} from one fused statistics job."""
    if not cols:
        return {}
    if method == "iqr":
        return _iqr_bounds(stats.scalar_quantiles(df, cols, [0.25, 0.75], quantile_method), cols, multiplier)
    if method == "zscore":
        row = stats.wide_agg(df, [e for c in cols for e in (
            F.avg(F.when(~missing(F.col(c), C.dtype_of(df, c)), F.col(c))).alias(f"m_{c}"),
            F.stddev_samp(F.when(~missing(F.col(c), C.dtype_of(df, c)), F.col(c))).alias(f"s_{c}"))],
            [2, 3] * len(cols))
        out = {}
        for c in cols:
            m, s = row[f"m_{c}"], row[f"s_{c}"]
            out[c] = (None, None) if m is None or s is None else (m - threshold * s, m + threshold * s)
        return out
    raise ValueError(f"unknown outlier method {method!r}")


def _iqr_bounds(q: dict, cols: list[str], multiplier: float) -> dict:
    out = {}
    for c in cols:
        q1, q3 = q[c]
        out[c] = (None, None) if q1 is None or q3 is None else \
            (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    return out


def iqr_bounds_and_counts(df: DataFrame, cols: list[str], multiplier: float = 1.5) -> tuple[dict, dict]:
    """C16 + C18 for the exact IQR method: bounds from the quartiles, then one aggregate with the bounds as literals."""
    if not cols:
        return {}, {}
    bounds = outlier_bounds(df, cols, "iqr", multiplier)
    return bounds, count_outliers(df, bounds)


def outside(c: str, lower, upper):
    """Outlier mask; NULL (and unknown bounds) count as inside."""
    if lower is None or upper is None:
        return F.lit(False)
    return F.coalesce((F.col(c) < F.lit(lower)) | (F.col(c) > F.lit(upper)), F.lit(False))


def count_outliers(df: DataFrame, bounds: dict) -> dict:
    """One aggregate counting every column's outliers."""
    if not bounds:
        return {}
    row = stats.wide_agg(df, [F.count_if(outside(c, lo, hi)).alias(f"n{i}") for i, (c, (lo, hi)) in enumerate(bounds.items())])
    return {c: int(row[f"n{i}"]) for i, c in enumerate(bounds)}


def clip_outliers(df: DataFrame, bounds: dict, counts: dict | None = None) -> DataFrame:
    """Clip columns that have outliers; those become double."""
    counts = counts if counts is not None else count_outliers(df, bounds)
    out = []
    for c in df.columns:
        lo, hi = bounds.get(c, (None, None))
        if c in bounds and counts.get(c, 0) > 0:
            out.append(clip(F.col(c).cast("double"), float(lo), float(hi)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def remove_outliers(df: DataFrame, cols: list[str], method: str = "iqr", multiplier: float = 1.5,
                    threshold: float = 3.0, quantile_method: str = "exact", log: _Log | None = None) -> DataFrame:
    """C20: remove outlier rows column after column.

    The bounds of a later column come from the rows that survived the earlier
    ones, so this is a chain of (statistics action, narrow filter).  Filters
    are narrow, so the lineage grows by one cheap step per column.
    """
    cur = df
    for c in cols:
        if method == "iqr" and quantile_method == "exact":
            b, k = iqr_bounds_and_counts(cur, [c], multiplier)
            (lo, hi), n = b[c], k[c]
        else:
            (lo, hi), = outlier_bounds(cur, [c], method, multiplier, threshold, quantile_method).values()
            n = count_outliers(cur, {c: (lo, hi)})[c]
        if n > 0:
            cur = cur.where(~outside(c, lo, hi))
            if log is not None:
                log.add("remove_outliers", c, n, lo, hi, method)
    return cur


# ---------------------------------------------------------------- pipeline

def clean(df: DataFrame, options: CleanOptions | dict | str | None = None,
          persist: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole pipeline; returns (cleaned table, C23 log table)."""
    if isinstance(options, str):
        opts = CleanOptions.from_json(options)
    elif isinstance(options, CleanOptions):
        opts = options
    else:
        opts = CleanOptions.from_dict(options)
    spark = df.sparkSession
    log = _Log()
    cur = df
    qm = opts.quantile_method

    method = opts.handle_missing
    nc = None
    if opts.drop_duplicates:
        # one shuffle: the de-duplicated table is persisted; its row count
        # comes with the null counts when those are needed anyway
        n_before = cur.count()
        cur = hold(drop_duplicates(cur))
        if method != "none":
            nc = {r["column_name"]: (r["n_rows"], r["n_missing"]) for r in stats.null_counts(cur).collect()}
            n_after = next(iter(nc.values()))[0] if nc else cur.count()
        else:
            n_after = cur.count()
        dups = n_before - n_after
        if dups > 0:
            log.add("drop_duplicates", None, dups)
    elif persist:
        cur = hold(cur)

    if method != "none":
        if nc is None:
            nc = {r["column_name"]: (r["n_rows"], r["n_missing"]) for r in stats.null_counts(cur).collect()}
        total_before = sum(m for _, m in nc.values())
        if total_before > 0:
            numeric = C.numeric_columns(cur)
            text = C.string_columns(cur)
            if method == "drop_rows":
                n_rows = next(iter(nc.values()))[0]
                cur = drop_missing_rows(cur)
                if persist:
                    cur = hold(cur)
                log.add("drop_missing_rows", None, n_rows - cur.count())
            elif method == "drop_cols":
                thr = opts.missing_col_drop_threshold
                drop = [c for c, (n, m) in nc.items() if n > 0 and m / n > thr]
                if drop:
                    cur = cur.drop(*drop)
                    for c in drop:
                        log.add("drop_sparse_column", c, nc[c][1], detail=f"threshold {thr}")
            else:
                num_cols = [c for c in numeric if nc[c][1] > 0]
                values = numeric_fill_values(cur, num_cols, method, opts.missing_numeric_fill, qm)
                cat_method = "mode" if method == "mode" else "fill"
                cat_cols = [c for c in text if nc[c][1] > 0]
                if method == "mode":
                    bool_cols = [c for c in C.categorical_columns(cur) if c not in text and nc[c][1] > 0]
                    cat_cols += bool_cols
                cvalues = categorical_fill_values(cur, cat_cols, cat_method, opts.missing_categorical_fill)
                if method == "mode":
                    for c in cat_cols:
                        if C.is_boolean(C.dtype_of(cur, c)):
                            cvalues[c] = None if cvalues[c] in (None, "Unknown") else cvalues[c] == "true"
                cur = apply_fills(cur, {**values, **cvalues})
                for c in num_cols:
                    v = values[c]
                    log.add("fill_numeric", c, nc[c][1] if v is not None else 0, detail=f"{method}={v}")
                for c in cat_cols:
                    log.add("fill_categorical", c, nc[c][1] if cvalues[c] is not None else 0,
                            detail=f"{cat_method}={cvalues[c]}")

    if opts.fix_datatypes:
        cur, converted = fix_types(cur)
        for c, t in converted:
            log.add("fix_type", c, None, detail=t)

    how = opts.handle_outliers
    if how:
        cols = [c for c in C.numeric_columns(cur) if c not in set(opts.outlier_exclude or ())]
        if how == "clip":
            if opts.outlier_method == "iqr" and qm == "exact":
                bounds, counts = iqr_bounds_and_counts(cur, cols, opts.iqr_multiplier)
            else:
                bounds = outlier_bounds(cur, cols, opts.outlier_method, opts.iqr_multiplier,
                                        opts.zscore_threshold, qm)
                counts = count_outliers(cur, bounds)
            cur = clip_outliers(cur, bounds, counts)
            for c in cols:
                if counts.get(c, 0) > 0:
                    log.add("clip_outliers", c, counts[c], *bounds[c], detail=opts.outlier_method)
        elif how == "remove":
            cur = remove_outliers(cur, cols, opts.outlier_method, opts.iqr_multiplier,
                                  opts.zscore_threshold, qm, log)
        else:
            raise ValueError(f"unknown handle_outliers {how!r}")

    if not log.rows:
        log.add("no_change", None, 0)
    return cur, log.frame(spark)


def residual_missing(df: DataFrame) -> int:
    """Total missing cells left in a table."""
    return int(sum(r["n_missing"] for r in stats.null_counts(df).collect()))
