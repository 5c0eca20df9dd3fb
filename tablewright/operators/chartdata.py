"""Chart data (D1-D16): the small tables a chart is drawn from.

Drawing is not part of the library; each plot type returns the aggregated
DataFrame behind it.  Binning uses one min/max aggregate and then a single
``groupBy`` (map-side combined); box and violin statistics reuse the exact
distributed quantiles; nothing collects rows to the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions.columns import missing, named
from . import stats
from .comoments import comoments
from .selection import matched

PLOT_TYPES = ("histogram", "scatter", "bar", "box", "line", "pie", "heatmap", "density_heatmap", "violin")
BAR_AGGS = ("mean", "sum", "min", "max", "median", "std", "var", "first", "last", "count", "size", "nunique")
# Group tables up to this many rows are broadcast when joined back to rows.
BROADCAST_GROUPS = 100_000


def check_plot_columns(df: DataFrame, x: str, y: str | None = None, color: str | None = None) -> str | None:
    """X and y must exist; an unknown colour column is ignored."""
    if x is None or x not in df.columns:
        raise ValueError(f"column {x!r} not found")
    if y is not None and y not in df.columns:
        raise ValueError(f"column {y!r} not found")
    return color if color in df.columns else None


def _present(c: str, df: DataFrame) -> Column:
    return ~missing(named(c), C.dtype_of(df, c))


def _value(c: str, df: DataFrame) -> Column:
    return F.when(_present(c, df), named(c))


def _bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """1-based bin of v in [lo, hi] split into n equal bins; hi goes to bin n."""
    width = (hi - lo) / n
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(F.floor((v - lo) / width) + 1, F.lit(n))).cast("int")


def histogram(df: DataFrame, x: str, n_bins: int = 20, color: str | None = None) -> DataFrame:
    """(color?, bin, bin_lower, bin_upper, count) over non-missing x."""
    color = check_plot_columns(df, x, color=color)
    v = df.select(*([color] if color else []), _value(x, df).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    rng = v.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    j = _with_scalars(v, rng)
    b = _bin(F.col("_x"), F.col("_lo"), F.col("_hi"), n_bins)
    keys = ([color] if color else []) + ["bin"]
    g = j.withColumn("bin", b).groupBy(*keys, "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    return g.select(*keys, (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_lower"),
                    (F.col("_lo") + F.col("bin") * width).alias("bin_upper"), "count")


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, sample_fraction: float | None = None,
            key: str | None = None) -> DataFrame:
    """X, y, colour and every other column as hover data.

    ``sample_fraction`` keeps a deterministic hash sample of ``key`` (a chart
    of a huge table needs one); without it every row is returned."""
    if y is None:
        raise ValueError("scatter needs x and y")
    color = check_plot_columns(df, x, y, color)
    first = [x, y] + ([color] if color and color not in (x, y) else [])
    out = df.select(*first, *[c for c in df.columns if c not in first])
    if sample_fraction is not None:
        if key is None:
            raise ValueError("a sample needs a key column")
        # the same key hash as the train/test split: first 32 bits of md5, modulo 10000
        h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 10000
        out = out.where(h < int(round(sample_fraction * 10000)))
    return out


def bar(df: DataFrame, x: str, y: str | None = None, agg: str = "mean", color: str | None = None,
        order_by: str | None = None) -> DataFrame:
    """Bar data.

    * no y: value counts of x (D7), columns (x, count);
    * count/size: rows per x, also where y is missing (D4), named y;
    * nunique: distinct y per x (D5);
    * numeric aggregates of y per x (D3); non-numeric y falls back to
      counts named ``count`` (D6).  Rows with missing x are dropped.
    The colour column never survives the aggregation (D16).
    """
    check_plot_columns(df, x, y, color)
    base = df.where(_present(x, df))
    if y is None:
        return value_counts(df, x)
    agg = agg.lower()
    if agg not in BAR_AGGS:
        raise ValueError(f"unknown aggregate {agg!r}")
    if agg in ("count", "size"):
        return base.groupBy(x).agg(F.count(F.lit(1)).alias(y))
    if agg == "nunique":
        return base.groupBy(x).agg(F.count_distinct(_value(y, df)).alias(y))
    ydt = C.dtype_of(df, y)
    if not (C.is_numeric(ydt) or C.is_boolean(ydt)):
        return base.groupBy(x).agg(F.count(F.lit(1)).alias("count"))
    yv = _value(y, df).cast("double")
    if agg == "median":
        inner = base.select(named(x).alias("__tw_x"), _value(y, df).cast("double").alias("__tw_y"))
        q = stats.quantile_table(inner, ["__tw_y"], [0.5], by=["__tw_x"]).drop("column_name")
        return inner.select("__tw_x").distinct().join(q, "__tw_x", "left").toDF(x, y)
    if agg in ("first", "last"):
        if order_by is None:
            raise ValueError("first/last need an order_by column (rows have no order)")
        f = F.min_by if agg == "first" else F.max_by
        return base.where(_present(y, df)).groupBy(x).agg(f(F.col(y), F.col(order_by)).alias(y))
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}[agg]
    out = fn(yv)
    return base.groupBy(x).agg((F.coalesce(out, F.lit(0.0)) if agg == "sum" else out).alias(y))


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """(x, count) with missing x dropped; display order count desc, x."""
    check_plot_columns(df, x)
    return df.where(_present(x, df)).groupBy(x).agg(F.count(F.lit(1)).alias("count"))


def _group_keys(x: str | None, color: str | None) -> list[str]:
    return [c for c in (x, color) if c]


def _with_scalars(rows: DataFrame, stats_df: DataFrame) -> DataFrame:
    """Attach the one row of a global statistics table as literals."""
    got = stats_df.collect()
    if len(got) > 1:
        raise ValueError("expected at most one statistics row")
    fields = stats_df.schema.fields
    vals = got[0].asDict() if got else {f.name: None for f in fields}
    return rows.select("*", *[F.lit(vals[f.name]).cast(f.dataType).alias(f.name) for f in fields])


def _matched_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their group; a NULL or NaN key is a group like others."""
    if not keys:
        return _with_scalars(rows, groups)
    got = groups.limit(BROADCAST_GROUPS + 1).collect()
    small = len(got) <= BROADCAST_GROUPS  # otherwise a shuffle join; AQE splits a skewed key's partition
    return matched(rows, df_of(groups, got) if small else groups, keys, small)


def df_of(like: DataFrame, rows: list) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, like.schema)


def box_stats(df: DataFrame, value: str, group: str | None = None, color: str | None = None,
              method: str = "exact") -> DataFrame:
    """Per group: n, q1, median, q3, fences at 1.5 IQR and whiskers
    (extreme values inside the fences)."""
    check_plot_columns(df, value, group, color)
    names = _group_keys(group, color)
    base = _box_rows(df, value, group, names).where(F.col("_y").isNotNull())
    box = _fenced(base, len(names), method)
    keys = _inner(names)
    return _matched_groups(base, box, keys).groupBy(*keys, "q1", "median", "q3", "lower_fence", "upper_fence").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("_y") >= F.col("lower_fence"), F.col("_y"))).alias("whisker_low"),
        F.max(F.when(F.col("_y") <= F.col("upper_fence"), F.col("_y"))).alias("whisker_high")).toDF(
            *names, "q1", "median", "q3", "lower_fence", "upper_fence", "n", "whisker_low", "whisker_high")


def _inner(names: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(names))]


def _box_rows(df: DataFrame, value: str, group: str | None, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Group columns as ``_k<i>``, kept ones as ``_o<i>`` and the value ``_y`` (missing, NaN too: NULL), without missing groups."""
    rows = df.where(_present(group, df)) if group else df
    return rows.select(*(named(n).alias(k) for n, k in zip(names, _inner(names))), *(named(c).alias(f"_o{i}") for i, c in enumerate(keep or [])),
                       _value(value, df).cast("double").alias("_y"))


def _fenced(base: DataFrame, n_keys: int, method: str) -> DataFrame:
    """Quartiles and fences of ``_y`` per group."""
    keys = [f"_k{i}" for i in range(n_keys)]
    q = stats.quantile_table(base, ["_y"], [0.25, 0.5, 0.75], by=keys, method=method, names=["q1", "median", "q3"]).drop("column_name")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return q.withColumns({"lower_fence": F.col("q1") - reach, "upper_fence": F.col("q3") + reach})


def box_outliers(df: DataFrame, value: str, group: str | None = None, color: str | None = None,
                 method: str = "exact", keep: list[str] | None = None) -> DataFrame:
    """Rows whose value lies outside the fences of their group; a missing value (NaN too) lies nowhere."""
    check_plot_columns(df, value, group, color)
    names = _group_keys(group, color)
    rows = _box_rows(df, value, group, names, keep).where(F.col("_y").isNotNull())
    box = _fenced(rows, len(names), method).select(*_inner(names), "lower_fence", "upper_fence")
    j = _matched_groups(rows, box, _inner(names)).where((F.col("_y") < F.col("lower_fence")) | (F.col("_y") > F.col("upper_fence")))
    return j.select(*_inner(names), *(f"_o{i}" for i in range(len(keep or []))), "_y").toDF(*names, *(keep or []), value)


def line(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Rows sorted by (colour, x, y); x must be numeric or a datetime."""
    if y is None:
        raise ValueError("line needs x and y")
    color = check_plot_columns(df, x, y, color)
    xdt = C.dtype_of(df, x)
    if not (C.is_numeric(xdt) or C.is_datetime(xdt)):
        raise ValueError(f"line needs a numeric or datetime x; {x!r} is {xdt.simpleString()}")
    cols = ([color] if color else []) + [x, y]
    return df.select(*cols).orderBy(*cols)


def pie(df: DataFrame, x: str, max_slices: int = 10) -> DataFrame:
    """(x as text, count): with more than ``max_slices`` values the
    largest ``max_slices - 1`` stay and the rest become ``Other``.

    The top values come from ``orderBy(...).limit`` (TakeOrderedAndProject:
    each partition keeps its own top rows), the rest from an anti join
    against that small set, so the count table is never ranked globally."""
    counts = value_counts(df, x).select(F.col(x).cast("string").alias(x), "count")
    n_values = counts.count()
    if n_values <= max_slices:
        return counts
    top = counts.orderBy(F.desc("count"), F.asc(x)).limit(max_slices - 1)
    other = counts.join(F.broadcast(top.select(x)), x, "left_anti") \
        .agg(F.sum("count").cast("long").alias("count")).select(F.lit("Other").alias(x), "count")
    return top.unionByName(other)


def correlation(df: DataFrame, cols: list[str] | None = None, x: str | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns (pairwise
    complete), long form (col_x, col_y, corr), from one scan whatever the
    number of columns; NULL where a column of the pair does not vary."""
    if x is not None:
        check_plot_columns(df, x)
    cols = list(cols if cols is not None else C.numeric_columns(df))
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    found = comoments(df, [_value(c, df) for c in cols])
    spread = np.sqrt(found["m2"] * found["m2"].T)
    corr = np.where(spread > 0, found["c"] / np.where(spread > 0, spread, 1), np.nan)
    rows = [(a, b, None if math.isnan(corr[i, j]) else 1.0 if i == j else float(corr[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_x string, col_y string, corr double")


def density_heatmap(df: DataFrame, x: str, y: str, nbins_x: int = 10, nbins_y: int = 10) -> DataFrame:
    """2-D histogram (bin_x, bin_y, count) over rows with both values."""
    if y is None:
        raise ValueError("density heatmap needs x and y")
    check_plot_columns(df, x, y)
    v = df.select(_value(x, df).cast("double").alias("_x"), _value(y, df).cast("double").alias("_y")) \
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    rng = v.agg(F.min("_x").alias("_xl"), F.max("_x").alias("_xh"), F.min("_y").alias("_yl"), F.max("_y").alias("_yh"))
    j = _with_scalars(v, rng)
    return j.select(_bin(F.col("_x"), F.col("_xl"), F.col("_xh"), nbins_x).alias("bin_x"),
                    _bin(F.col("_y"), F.col("_yl"), F.col("_yh"), nbins_y).alias("bin_y")) \
        .groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("count"))


def violin_density(df: DataFrame, value: str, group: str | None = None, grid_points: int = 16,
                   method: str = "exact", color: str | None = None) -> DataFrame:
    """Gaussian kernel density per group (and colour) on an even grid from min to max; ``violin_box`` is its box part.

    Bandwidth (Silverman): 0.9 * min(sd, IQR / 1.34) * n^(-1/5).  Values are
    first counted per (group, value), each distinct value is spread over the
    ``grid_points`` grid of its group (a fixed fan-out, not a pairing of
    rows), and the weighted kernel sums are aggregated per grid point.
    Output (group?, color?, k, grid_value, density)."""
    check_plot_columns(df, value, group, color)
    names = _group_keys(group, color if color in df.columns else None)
    keys = _inner(names)
    base = _box_rows(df, value, group, names).where(F.col("_y").isNotNull())
    # one counted table serves the moments and the kernel sums
    counts = base.groupBy(*keys, "_y").agg(F.count(F.lit(1)).alias("_w"))
    mom = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_y").alias("_sd"),
                                  F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    q = _fenced(base, len(names), method).select(*keys, F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
    g = _matched_groups(mom, q, keys)
    g = g.withColumn("_bw", 0.9 * F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
                     * F.pow(F.col("_n").cast("double"), -0.2))
    g = g.where(F.col("_bw") > 0)
    j = _matched_groups(counts, g, keys)
    step = (F.col("_hi") - F.col("_lo")) / (grid_points - 1)
    j = j.select(*keys, "_y", "_w", "_n", "_bw", "_lo", "_hi",
                 F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("k"))
    j = j.withColumn("grid_value", F.col("_lo") + F.col("k") * step)
    u = (F.col("grid_value") - F.col("_y")) / F.col("_bw")
    kern = F.col("_w") * F.exp(-0.5 * u * u)
    return j.groupBy(*keys, "k", "grid_value", "_n", "_bw").agg(F.sum(kern).alias("_s")) \
        .select(*keys, "k", "grid_value",
                (F.col("_s") / (F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density")) \
        .toDF(*names, "k", "grid_value", "density")


def violin_box(df: DataFrame, value: str, group: str | None = None, color: str | None = None, method: str = "exact") -> DataFrame:
    """The box drawn inside each violin: that of D8 for the same group and colour."""
    return box_stats(df, value, group, color if color in df.columns else None, method)


def chart_data(df: DataFrame, plot_type: str, x: str, y: str | None = None, color: str | None = None,
               **kw) -> DataFrame:
    """One entry point in the reference's shape; unknown types raise (Q16)."""
    t = plot_type.lower()
    if t == "histogram":
        return histogram(df, x, color=color, **kw)
    if t == "scatter":
        return scatter(df, x, y, color, **kw)
    if t == "bar":
        return bar(df, x, y, color=color, **kw)
    if t == "box":
        return box_stats(df, y, x, color, **kw) if y else box_stats(df, x, None, color, **kw)
    if t == "line":
        return line(df, x, y, color)
    if t == "pie":
        return pie(df, x, **kw)
    if t == "heatmap":
        return correlation(df, x=x, **kw)
    if t == "density_heatmap":
        return density_heatmap(df, x, y, **kw)
    if t == "violin":
        return violin_density(df, y, x, color=color, **kw) if y else violin_density(df, x, None, color=color, **kw)
    raise ValueError(f"unknown plot type {plot_type!r}; choose from {', '.join(PLOT_TYPES)}")
