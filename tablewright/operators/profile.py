"""Table profile (B1-B12): a handful of small DataFrames, three scans.

* one wide aggregate: row count, per-column missing counts, logical bytes;
* one ``groupBy(all columns)`` for duplicate rows (map-side combined);
* one unpivot of the categorical columns -> ``groupBy(column, value)``, counted
  once and held, feeding distinct counts and the top-k window;
* numeric summary: one moments aggregate + the distributed exact quantiles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as X
from ..functions import classes as C
from ..functions.columns import missing
from . import stats
from .cache import hold

# Fixed widths (bytes) used for the logical table size.
FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.DecimalType: 16, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _width(dt: T.DataType):
    for k, v in FIXED_WIDTH.items():
        if isinstance(dt, k):
            return v
    return None


def column_bytes(name: str, dt: T.DataType):
    """Logical size of one cell: fixed width, byte length of text, or the
    sum over array elements."""
    c = X.named(name)
    w = _width(dt)
    if w is not None:
        return F.when(c.isNotNull(), F.lit(w))
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(dt, T.ArrayType):
        ew = _width(dt.elementType)
        if ew is not None:
            return F.size(c) * ew
        if isinstance(dt.elementType, T.StringType):
            return F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.octet_length(x), F.lit(0)))
    return F.octet_length(F.to_json(F.struct(c)))


def overview(df: DataFrame) -> DataFrame:
    """B1 + B7: (n_rows, n_columns, logical_bytes) from one aggregate."""
    exprs = [F.count(F.lit(1)).alias("n_rows")]
    exprs += [F.coalesce(F.sum(column_bytes(f.name, f.dataType)), F.lit(0)).cast("long").alias(f"b{i}")
              for i, f in enumerate(df.schema.fields)]
    got = stats.wide_agg(df, exprs, [1] + [2] * len(df.schema.fields))
    size = sum(int(got[f"b{i}"]) for i in range(len(df.schema.fields)))
    return df.sparkSession.createDataFrame([(int(got["n_rows"]), len(df.columns), size)],
                                           "n_rows long, n_columns int, logical_bytes long")


def column_types(df: DataFrame) -> DataFrame:
    """B2: (position, column_name, data_type)."""
    spark = df.sparkSession
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column_name string, data_type string")


def missing_table(df: DataFrame, decimals: int = 2, cols: list[str] | None = None) -> DataFrame:
    """(column_name, n_missing, missing_pct); pct is NULL for an empty table.
    Order for display: ``orderBy(desc('missing_pct'), 'column_name')``."""
    nc = stats.null_counts(df, cols)
    pct = F.when(F.col("n_rows") > 0, F.col("n_missing") / F.col("n_rows") * 100)
    return nc.select("column_name", "n_missing", X.round_half_even(pct, decimals).alias("missing_pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows after the first of each identical group (missing values, NULL or NaN, equal)."""
    keys = df.select(*X.row_digest([X.nan_to_null(X.named(f.name), f.dataType) for f in df.schema.fields]))  # rows do not move, digests do
    return keys.groupBy("__tw_h0", "__tw_h1") \
        .agg(F.count(F.lit(1)).alias("__tw_n")) \
        .agg(F.coalesce(F.sum(F.col("__tw_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def numeric_summary(df: DataFrame, cols: list[str] | None = None, decimals: int | None = 2,
                    method: str = "exact") -> DataFrame:
    """One row per numeric column: count, mean, std, min, q25, q50, q75, max."""
    cols = list(cols if cols is not None else C.numeric_columns(df))
    m = stats.moments(df, cols)
    q = stats.quantile_table(df, cols, [0.25, 0.5, 0.75], method=method, names=["q25", "q50", "q75"])
    out = F.broadcast(m).join(F.broadcast(q), "column_name", "left") if len(cols) < 10_000 else m.join(q, "column_name", "left")
    names = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    if decimals is not None:
        return out.select("column_name", "count", *[X.round_half_even(F.col(n), decimals).alias(n) for n in names])
    return out.select("column_name", "count", *names)


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, n) for categorical columns, NULLs dropped."""
    long = stats.long_values(df, cols, value_type="string")
    return long.groupBy("column_name", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def categorical_summary(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column_name, unique_values, distinct_frequencies).

    ``unique_values`` is the intended distinct count; ``distinct_frequencies``
    reproduces the reference's literal number (distinct counts of counts)."""
    cols = list(cols if cols is not None else C.categorical_columns(df))
    if approx:
        long = stats.long_values(df, cols, value_type="string")
        return long.groupBy("column_name").agg(F.approx_count_distinct("v").alias("unique_values"))
    return categorical_of_counts(value_counts_long(df, cols))


def categorical_of_counts(counts: DataFrame) -> DataFrame:
    """``categorical_summary`` from (column_name, value, n)."""
    by_frequency = counts.groupBy("column_name", "n").agg(F.count(F.lit(1)).alias("values"))
    return by_frequency.groupBy("column_name").agg(F.sum("values").alias("unique_values"),
                                                   F.count(F.lit(1)).alias("distinct_frequencies"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column_name, rank, value, n): k most frequent values per column,
    ties by value.  ``row_number() <= k`` lets Spark put a partial
    WindowGroupLimit before the shuffle, so at most k rows per column leave
    each partition."""
    cols = list(cols if cols is not None else C.categorical_columns(df))
    return top_of_counts(value_counts_long(df, cols), k)


def top_of_counts(counts: DataFrame, k: int = 5) -> DataFrame:
    """``top_values`` from (column_name, value, n)."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("column_name", "rank", "value", "n")


@dataclass
class Profile:
    overview: DataFrame
    column_types: DataFrame
    missing: DataFrame
    duplicates: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    top_values: DataFrame
    #: part -> (columns, its table for some of them): how ``collect`` finds the columns that fail
    per_column: dict[str, tuple[list[str], Callable[[list[str]], DataFrame]]] = field(default_factory=dict)
    #: part -> error rows of columns that failed while the profile was built
    failed: dict[str, list[dict]] = field(default_factory=dict)

    def parts(self) -> dict[str, DataFrame]:
        return {"overview": self.overview, "column_types": self.column_types, "missing": self.missing,
                "duplicates": self.duplicates, "numeric_summary": self.numeric,
                "categorical_summary": self.categorical, "top_values": self.top_values}

    def collect(self) -> dict:
        """B12 on the driver: every (small) part as a list of dicts.

        A column that fails is a row ``{"column_name": ..., "error": message}`` of its part, the other columns keep
        their values: a part that fails is cut in halves of its columns until the failing ones stand alone.  A part
        that fails by itself, not by a column, is recorded as ``{"error": message}``."""
        out = {}
        for name, d in self.parts().items():
            try:
                out[name] = [r.asDict() for r in d.collect()]
            except Exception as e:  # noqa: BLE001 - recorded, as the reference does per column
                cols, build = self.per_column.get(name, ([], None))
                rows = _by_column(cols, build) if cols else []
                out[name] = rows if any("error" in r for r in rows) else {"error": _message(e)}
            if isinstance(out[name], list):
                out[name] += self.failed.get(name, [])
        return out

    def to_json(self) -> DataFrame:
        """The whole profile as one JSON document (one row, one column).

        Each part becomes one (order, name, json) row; the parts are unioned
        and folded by one small aggregate (a handful of rows, no joins)."""
        def part(i: int, name: str, d: DataFrame, as_list: bool = True) -> DataFrame:
            body = F.to_json(F.collect_list(F.struct(*d.columns))) if as_list \
                else F.to_json(F.first(F.struct(*d.columns)))
            return d.agg(body.alias("j")).select(F.lit(i).alias("i"), F.lit(name).alias("k"), "j")
        parts = [part(0, "overview", self.overview, False), part(1, "duplicates", self.duplicates, False),
                 part(2, "column_types", self.column_types), part(3, "missing", self.missing),
                 part(4, "numeric_summary", self.numeric), part(5, "categorical_summary", self.categorical),
                 part(6, "top_values", self.top_values)]
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        items = F.sort_array(F.collect_list(F.struct("i", F.concat(F.lit('"'), F.col("k"), F.lit('":'),
                                                                   F.coalesce(F.col("j"), F.lit("null"))).alias("t"))))
        return u.agg(F.concat(F.lit("{"), F.array_join(F.transform(items, lambda x: x["t"]), ","), F.lit("}"))
                     .alias("profile_json"))


def _message(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _by_column(cols: list[str], build: Callable[[list[str]], DataFrame]) -> list[dict]:
    """Rows of the columns that work and one error row for each that fails, by halving: few failing columns cost few jobs."""
    out, mid = [], len(cols) // 2
    for part in (cols[:mid], cols[mid:]) if mid else (cols,):
        try:
            out += [r.asDict() for r in build(part).collect()]
        except Exception as e:  # noqa: BLE001 - recorded per column
            out += _by_column(part, build) if len(part) > 1 else [{"column_name": part[0], "error": _message(e)}]
    return out


def _accepted(cols: list[str], build: Callable[[list[str]], DataFrame], errors: list[dict]) -> list[str]:
    """The columns whose part Spark can analyse; the others become ``errors``.  Nothing is read."""
    try:
        _ = build(cols).schema if cols else None
        return cols
    except Exception as e:  # noqa: BLE001 - recorded per column
        if len(cols) == 1:
            errors.append({"column_name": cols[0], "error": _message(e)})
            return []
        mid = len(cols) // 2
        return _accepted(cols[:mid], build, errors) + _accepted(cols[mid:], build, errors)


def _built(cols: list[str], build: Callable[[list[str]], DataFrame], empty: DataFrame, errors: list[dict]) -> DataFrame:
    """``build(cols)``, which takes jobs of its own; where one fails, the rows of the columns that do not, and ``errors``."""
    try:
        return build(cols) if cols else empty
    except Exception:  # noqa: BLE001 - recorded per column
        rows = _by_column(cols, build)
        errors += [r for r in rows if "error" in r]
        fine = [tuple(r[c] for c in empty.columns) for r in rows if "error" not in r]
        return empty.sparkSession.createDataFrame(fine, empty.schema)


def _or_error(spark, build: Callable[[], DataFrame]) -> DataFrame:
    try:
        return build()
    except Exception as e:  # noqa: BLE001 - recorded, the other parts go on
        return spark.createDataFrame([(_message(e),)], "error string")


def profile(df: DataFrame, top_k: int = 5, decimals: int = 2, method: str = "exact") -> Profile:
    """All profile parts as small DataFrames; the values of the categorical columns are counted once for B10 and B11.

    A column that fails does not take the others with it, see ``Profile.collect``; a part about the whole table that
    fails is one row with its ``error``."""
    spark = df.sparkSession
    failed: dict[str, list[dict]] = {"missing": [], "numeric_summary": [], "categorical_summary": []}
    num = _accepted(C.numeric_columns(df), lambda c: stats.moments(df, c), failed["numeric_summary"])
    cat = _accepted(C.categorical_columns(df), lambda c: value_counts_long(df, c), failed["categorical_summary"])
    failed["top_values"] = failed["categorical_summary"]
    empty_num = spark.createDataFrame([], "column_name string, count long, mean double, std double, min double, "
                                          "q25 double, q50 double, q75 double, max double")
    empty_cat = spark.createDataFrame([], "column_name string, unique_values long, distinct_frequencies long")
    empty_top = spark.createDataFrame([], "column_name string, rank int, value string, n long")
    empty_missing = spark.createDataFrame([], "column_name string, n_missing long, missing_pct double")
    counts = hold(value_counts_long(df, cat)) if cat else None
    summary = lambda c: numeric_summary(df, c, decimals, method)
    gaps = lambda c: missing_table(df, decimals, c)
    return Profile(
        overview=_or_error(spark, lambda: overview(df)), column_types=column_types(df),
        missing=_built(df.columns, gaps, empty_missing, failed["missing"]), duplicates=duplicate_rows(df),
        numeric=_built(num, summary, empty_num, failed["numeric_summary"]),
        categorical=categorical_of_counts(counts) if cat else empty_cat,
        top_values=top_of_counts(counts, top_k) if cat else empty_top,
        per_column={"numeric_summary": (num, summary),
                    "categorical_summary": (cat, lambda c: categorical_summary(df, c)),
                    "top_values": (cat, lambda c: top_values(df, c, top_k))},
        failed=failed)
