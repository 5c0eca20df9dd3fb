"""Cleaning queries (C1-C23) over the dirty orders view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.columns import NUMBER_PATTERN, parse_date_with
from ..operators import clean as CL
from ..operators import stats
from ..operators.cache import hold, spread
from .fixtures import dirty_orders, table, with_dirty
from .registry import query

DIRTY_COLS = ["o_orderkey", "price", "priority", "cust_txt", "date_txt", "sparse_status"]
TEXT_COLS = ["priority", "cust_txt", "date_txt", "sparse_status"]
NUM_GUARD = NUMBER_PATTERN  # DuckDB regexp_matches takes the same pattern text


def _round(df, cols, scale=4):
    return df.select(*[X.round_half_up(F.col(c), scale).alias(c) if c in cols else F.col(c) for c in df.columns])


def _num(c):
    return (f"case when regexp_matches(trim({c}), '{NUM_GUARD}') "
            f"then try_cast(trim({c}) as double) end")


@query("c01_drop_duplicates", with_dirty("select distinct * from dirty"), ("C1",))
def c01(spark, sf):
    return CL.drop_duplicates(dirty_orders(spark, sf))


@query("c01_duplicate_count", with_dirty(
    "select cast((select count(*) from dirty) - (select count(*) from (select distinct * from dirty))"
    " as bigint) as n_duplicates"), ("C1", "B6"))
def c01_count(spark, sf):
    d = dirty_orders(spark, sf)
    return d.groupBy(*d.columns).count().agg(F.sum(F.col("count") - 1).cast("long").alias("n_duplicates"))


@query("c02_drop_missing_rows", with_dirty(
    "select * from dirty where " + " and ".join(f"{c} is not null" for c in DIRTY_COLS)
    + " and not isnan(price)"), ("C2",))
def c02(spark, sf):
    return CL.drop_missing_rows(dirty_orders(spark, sf))


@query("c03_sparse_columns", with_dirty(
    "u as (" + " union all ".join(
        f"select '{c}' as column_name, cast(count(*) - count({c}) as bigint) as n_missing, count(*) as n_rows from dirty"
        for c in DIRTY_COLS) + ")\n"
    "select column_name, n_missing, round(n_missing / n_rows, 6) as missing_share, n_missing / n_rows > 0.5 as dropped from u"),
    ("C3",))
def c03_report(spark, sf):
    nc = stats.null_counts(dirty_orders(spark, sf))
    share = F.col("n_missing") / F.col("n_rows")
    return nc.select("column_name", "n_missing", X.round_half_up(share, 6).alias("missing_share"), (share > 0.5).alias("dropped"))


@query("c03_drop_sparse_columns", with_dirty(
    "select o_orderkey, price, priority, cust_txt, date_txt from dirty"), ("C3",))
def c03(spark, sf):
    return CL.drop_sparse_columns(dirty_orders(spark, sf), 0.5)


def _fill_sql(num_expr: str, cat: str, mode_cat: bool = False) -> str:
    cats = ", ".join(
        (f"coalesce({c}, (select {c} from dirty where {c} is not null group by {c} "
         f"order by count(*) desc, {c} limit 1)) as {c}") if mode_cat else f"coalesce({c}, '{cat}') as {c}"
        for c in TEXT_COLS)
    src = "dirty" if "(" in num_expr else "(select 1) as one"
    return with_dirty(f"s as (select {num_expr} as fv from {src})\n"
                      f"select o_orderkey, round(coalesce(price, (select fv from s)), 4) as price, {cats} from dirty")


@query("c04_fill_mean", _fill_sql("avg(price)", "Unknown"), ("C4", "C8"))
def c04(spark, sf):
    out, _ = CL.clean(dirty_orders(spark, sf), {"handle_missing": "mean"})
    return _round(out, ["price"])


@query("c05_fill_median", _fill_sql("quantile_cont(price, 0.5)", "Unknown"), ("C5", "C8"))
def c05(spark, sf):
    out, _ = CL.clean(dirty_orders(spark, sf), {"handle_missing": "median"})
    return _round(out, ["price"])


@query("c06_fill_mode", with_dirty(
    "m as (select price as fv from dirty where price is not null group by price order by count(*) desc, price limit 1)\n"
    "select o_orderkey, round(coalesce(price, (select fv from m)), 4) as price, " + ", ".join(
        f"coalesce({c}, (select {c} from dirty where {c} is not null group by {c} order by count(*) desc, {c} limit 1))"
        f" as {c}" for c in TEXT_COLS) + " from dirty"), ("C6", "C9"))
def c06(spark, sf):
    out, _ = CL.clean(dirty_orders(spark, sf), {"handle_missing": "mode"})
    return _round(out, ["price"])


@query("c07_fill_constant", _fill_sql("-1.0", "Unknown"), ("C7", "C8"))
def c07(spark, sf):
    out, _ = CL.clean(dirty_orders(spark, sf), {"handle_missing": "fill", "missing_numeric_fill": -1.0})
    return _round(out, ["price"])


@query("c08_fill_categorical_constant", _fill_sql("0.0", "MISSING"), ("C8",))
def c08(spark, sf):
    out, _ = CL.clean(dirty_orders(spark, sf), {"handle_missing": "fill", "missing_categorical_fill": "MISSING"})
    return _round(out, ["price"])


@query("c09_modes", with_dirty(
    "u as (" + " union all ".join(
        f"select '{c}' as column_name, cast({c} as varchar) as v, count(*) as n from dirty where {c} is not null group by {c}"
        for c in ["priority", "cust_txt", "date_txt", "sparse_status"]) + "),\n"
    "r as (select column_name, v, n, row_number() over (partition by column_name order by n desc, v) as rn from u)\n"
    "select column_name, v as mode, n as mode_count from r where rn = 1"), ("C9", "C6"))
def c09(spark, sf):
    return stats.modes(dirty_orders(spark, sf), ["priority", "cust_txt", "date_txt", "sparse_status"])


# Residual missing cells after dedupe, median fill and type fixing: "Unknown"
# written into a numeric-looking text column turns missing again (Q5).
@query("c10_residual_missing", with_dirty(
    "d as (select distinct * from dirty),\n"
    "f as (select o_orderkey, coalesce(price, (select quantile_cont(price, 0.5) from d)) price, "
    + ", ".join(f"coalesce({c}, 'Unknown') as {c}" for c in TEXT_COLS) + " from d),\n"
    f"dec as (select count(*) n, count(cust_txt) nn, count({_num('cust_txt')}) p from f),\n"
    "t as (select o_orderkey, price, priority, "
    f"case when (select p > 0.8 * nn and nn - p < 0.1 * n from dec) then ({_num('cust_txt')}) is null "
    "else cust_txt is null end as cust_missing, "
    "try_strptime(trim(date_txt), '%Y-%m-%d') as date_txt, sparse_status from f)\n"
    "select * from (" + " union all ".join(
        f"select '{c}' as column_name, cast(count(*) - count({c}) as bigint) as n_missing from t"
        for c in DIRTY_COLS if c != "cust_txt")
    + " union all select 'cust_txt', cast(count_if(cust_missing) as bigint) from t)"), ("C10", "Q5"))
def c10(spark, sf):
    out, _ = CL.clean(dirty_orders(spark, sf), {"drop_duplicates": True, "handle_missing": "median",
                                                "fix_datatypes": True})
    return stats.null_counts(out).select("column_name", "n_missing")


def _detect_sql() -> str:
    parts = []
    for c in TEXT_COLS:
        parts.append(
            f"select '{c}' as column_name, count(*) as n_rows, count({c}) as n_non_null, count({_num(c)}) as n_numeric, "
            f"coalesce(bool_and(({_num(c)}) % 1 = 0), true) as all_whole, "
            f"coalesce(bool_or(regexp_matches({c}, '(\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}})|(\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}})')), false) as looks_like_date, "
            f"count(try_strptime(trim({c}), '%Y-%m-%d')) as n_dates from dirty")
    return with_dirty("u as (" + " union all ".join(parts) + ")\n"
                      "select *, case when n_numeric > 0.8 * n_non_null and n_non_null - n_numeric < 0.1 * n_rows "
                      "then (case when all_whole then 'integer' else 'double' end) "
                      "when looks_like_date and n_dates > 0.8 * n_non_null then 'timestamp' end as target from u")


def _detect(spark, sf):
    return CL.detect_types(dirty_orders(spark, sf), TEXT_COLS)


@query("c11_numeric_detection", f"select column_name, n_rows, n_non_null, n_numeric, "
       f"n_numeric > 0.8 * n_non_null and n_non_null - n_numeric < 0.1 * n_rows as numeric from ({_detect_sql()})",
       ("C11", "H1"))
def c11(spark, sf):
    d = _detect(spark, sf)
    return d.select("column_name", "n_rows", "n_non_null", "n_numeric",
                    ((F.col("n_numeric") > 0.8 * F.col("n_non_null"))
                     & (F.col("n_non_null") - F.col("n_numeric") < 0.1 * F.col("n_rows"))).alias("numeric"))


@query("c12_integer_narrowing", f"select column_name, all_whole, target from ({_detect_sql()}) "
       "where target in ('integer', 'double')", ("C12", "H7"))
def c12(spark, sf):
    return _detect(spark, sf).where(F.col("target").isin("integer", "double")).select("column_name", "all_whole", "target")


@query("c13_date_pattern", f"select column_name, looks_like_date from ({_detect_sql()})", ("C13", "H3"))
def c13(spark, sf):
    return _detect(spark, sf).select("column_name", "looks_like_date")


@query("c14_date_conversion", with_dirty(
    "select o_orderkey, date_txt as raw, try_strptime(trim(date_txt), '%Y-%m-%d') as parsed from dirty"),
    ("C14", "H2"))
def c14(spark, sf):
    d = dirty_orders(spark, sf)
    rows = CL.detect_types(d, ["date_txt"]).collect()[0]
    if rows["target"] != "timestamp":
        raise AssertionError("date_txt should convert")
    return d.select("o_orderkey", F.col("date_txt").alias("raw"),
                    parse_date_with(F.col("date_txt"), rows["best_date_format"]).alias("parsed"))


@query("c15_fix_types", with_dirty(
    f"select o_orderkey, price, priority, cast({_num('cust_txt')} as bigint) as cust_txt, "
    "try_strptime(trim(date_txt), '%Y-%m-%d') as date_txt, sparse_status from dirty"), ("C15",))
def c15(spark, sf):
    out, _ = CL.fix_types(dirty_orders(spark, sf))
    return out


def _typed_numeric_sql() -> str:
    return (f"t as (select o_orderkey, price, cast({_num('cust_txt')} as bigint) as cust_txt from dirty)")


@query("c16_iqr_bounds", with_dirty(
    _typed_numeric_sql() + ",\nq as (" + " union all ".join(
        f"select '{c}' as column_name, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from t"
        for c in ["o_orderkey", "price", "cust_txt"]) + ")\n"
    "select column_name, round(q1 - 1.5 * (q3 - q1), 4) as lower, round(q3 + 1.5 * (q3 - q1), 4) as upper from q"),
    ("C16",))
def c16(spark, sf):
    t, _ = CL.fix_types(dirty_orders(spark, sf))
    b = CL.outlier_bounds(t, ["o_orderkey", "price", "cust_txt"], "iqr")
    return spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in b.items()], "column_name string, lower double, upper double") \
        .select("column_name", X.round_half_up("lower", 4).alias("lower"), X.round_half_up("upper", 4).alias("upper"))


@query("c17_zscore_bounds", with_dirty(
    _typed_numeric_sql() + ",\nq as (" + " union all ".join(
        f"select '{c}' as column_name, avg({c}) as m, stddev_samp({c}) as s from t"
        for c in ["o_orderkey", "price", "cust_txt"]) + ")\n"
    "select column_name, round(m - 3 * s, 4) as lower, round(m + 3 * s, 4) as upper from q"), ("C17",))
def c17(spark, sf):
    t, _ = CL.fix_types(dirty_orders(spark, sf))
    b = CL.outlier_bounds(t, ["o_orderkey", "price", "cust_txt"], "zscore", threshold=3)
    return spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in b.items()], "column_name string, lower double, upper double") \
        .select("column_name", X.round_half_up("lower", 4).alias("lower"), X.round_half_up("upper", 4).alias("upper"))


@query("c18_outlier_counts", with_dirty(
    _typed_numeric_sql() + ",\nb as (" + " union all ".join(
        f"select '{c}' as column_name, 'iqr' as method, quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from t union all "
        f"select '{c}', 'zscore', avg({c}) - 3 * stddev_samp({c}), avg({c}) + 3 * stddev_samp({c}) from t"
        for c in ["o_orderkey", "price", "cust_txt"]) + ")\n"
    "select b.column_name, b.method, cast(sum(case when (b.column_name = 'o_orderkey' and (t.o_orderkey < lo or t.o_orderkey > hi)) "
    "or (b.column_name = 'price' and (t.price < lo or t.price > hi)) or (b.column_name = 'cust_txt' and (t.cust_txt < lo or t.cust_txt > hi)) "
    "then 1 else 0 end) as bigint) as n_outliers from b, t group by b.column_name, b.method"), ("C18",))
def c18(spark, sf):
    t, _ = CL.fix_types(dirty_orders(spark, sf))
    t = hold(t)
    cols = ["o_orderkey", "price", "cust_txt"]
    rows = []
    for method in ("iqr", "zscore"):
        b = CL.outlier_bounds(t, cols, method)
        n = CL.count_outliers(t, b)
        rows += [(c, method, n[c]) for c in cols]
    return spark.createDataFrame(rows, "column_name string, method string, n_outliers long")


@query("c19_clip_outliers", with_dirty(
    "q as (select quantile_cont(o_orderkey, 0.25) k1, quantile_cont(o_orderkey, 0.75) k3, "
    "quantile_cont(price, 0.25) p1, quantile_cont(price, 0.75) p3 from dirty)\n"
    "select o_orderkey, "
    "case when price is not null then round(greatest(least(price, p3 + 1.5 * (p3 - p1)), p1 - 1.5 * (p3 - p1)), 4) end as price, "
    "priority, cust_txt, date_txt, sparse_status from dirty, q"), ("C19", "H4"))
def c19(spark, sf):
    d = dirty_orders(spark, sf)
    b = CL.outlier_bounds(d, ["o_orderkey", "price"], "iqr")
    return _round(CL.clip_outliers(d, b), ["price"])


@query("c20_remove_outliers_iqr", with_dirty(
    f"t as (select o_orderkey, price, priority, cast({_num('cust_txt')} as bigint) as cust_txt, "
    "try_strptime(trim(date_txt), '%Y-%m-%d') as date_txt, sparse_status from (select distinct * from dirty)),\n"
    "b1 as (select quantile_cont(o_orderkey, 0.25) a, quantile_cont(o_orderkey, 0.75) z from t),\n"
    "r1 as (select t.* from t, b1 where not coalesce(o_orderkey < a - 1.5 * (z - a) or o_orderkey > z + 1.5 * (z - a), false)),\n"
    "b2 as (select quantile_cont(price, 0.25) a, quantile_cont(price, 0.75) z from r1),\n"
    "r2 as (select r1.* from r1, b2 where not coalesce(price < a - 1.5 * (z - a) or price > z + 1.5 * (z - a), false)),\n"
    "b3 as (select quantile_cont(cust_txt, 0.25) a, quantile_cont(cust_txt, 0.75) z from r2)\n"
    "select r2.* from r2, b3 where not coalesce(cust_txt < a - 1.5 * (z - a) or cust_txt > z + 1.5 * (z - a), false)"),
    ("C20",))
def c20(spark, sf):
    d = CL.drop_duplicates(dirty_orders(spark, sf))
    t, _ = CL.fix_types(d)
    return CL.remove_outliers(hold(t), ["o_orderkey", "price", "cust_txt"], "iqr")


def _default_sql(select: str) -> str:
    return with_dirty(
        "d as (select distinct * from dirty),\n"
        "f as (select o_orderkey, coalesce(price, (select quantile_cont(price, 0.5) from d)) as price, "
        + ", ".join(f"coalesce({c}, 'Unknown') as {c}" for c in TEXT_COLS) + " from d),\n"
        "t as (select o_orderkey, price, priority, cust_txt, "
        "try_strptime(trim(date_txt), '%Y-%m-%d') as date_txt, sparse_status from f),\n"
        "q as (select quantile_cont(price, 0.25) q1, quantile_cont(price, 0.75) q3 from t)\n" + select)


@query("c22_clean_default", _default_sql(
    "select o_orderkey, round(greatest(least(price, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 4) as price, "
    "priority, cust_txt, date_txt, sparse_status from t, q"), ("C22", "C21"))
def c22(spark, sf):
    out, _ = CL.clean(dirty_orders(spark, sf))
    return _round(out, ["price"])


@query("c23_cleaning_log", _default_sql(
    "select * from (\n"
    "select 1 as step_no, 'drop_duplicates' as step, null as column_name, "
    "  cast((select count(*) from dirty) - (select count(*) from d) as bigint) as n_affected, null::double as lower, null::double as upper\n"
    "union all select 2, 'fill_numeric', 'price', (select count(*) - count(price) from d), null, null\n"
    "union all select 3, 'fill_categorical', 'priority', (select count(*) - count(priority) from d), null, null\n"
    "union all select 4, 'fill_categorical', 'cust_txt', (select count(*) - count(cust_txt) from d), null, null\n"
    "union all select 5, 'fill_categorical', 'sparse_status', (select count(*) - count(sparse_status) from d), null, null\n"
    "union all select 6, 'fix_type', 'date_txt', null, null, null\n"
    "union all select 7, 'clip_outliers', 'price', (select count(*) from t, q where price < q1 - 1.5 * (q3 - q1) or price > q3 + 1.5 * (q3 - q1)), "
    "  round((select q1 - 1.5 * (q3 - q1) from q), 4), round((select q3 + 1.5 * (q3 - q1) from q), 4))"), ("C23",))
def c23(spark, sf):
    _, log = CL.clean(dirty_orders(spark, sf))
    return log.select("step_no", "step", "column_name", "n_affected",
                      X.round_half_up("lower", 4).alias("lower"), X.round_half_up("upper", 4).alias("upper"))


@query("c19_clip_outliers_zscore", with_dirty(
    "s as (select avg(price) m, stddev_samp(price) sd from dirty)\n"
    "select o_orderkey, case when price is not null then "
    "round(greatest(least(price, m + 3 * sd), m - 3 * sd), 4) end as price, priority, cust_txt, date_txt, sparse_status "
    "from dirty, s"), ("C17", "C19"))
def c19z(spark, sf):
    out, _ = CL.clean(dirty_orders(spark, sf), {"handle_outliers": "clip", "outlier_method": "zscore",
                                                "outlier_exclude": ["o_orderkey"]})
    return _round(out, ["price"])


@query("c20_remove_outliers_zscore", with_dirty(
    "b1 as (select avg(price) m, stddev_samp(price) sd from dirty),\n"
    "r1 as (select dirty.* from dirty, b1 where not coalesce(price < m - 3 * sd or price > m + 3 * sd, false)),\n"
    "b2 as (select avg(o_orderkey) m, stddev_samp(o_orderkey) sd from r1)\n"
    "select r1.* from r1, b2 where not coalesce(o_orderkey < m - 3 * sd or o_orderkey > m + 3 * sd, false)"),
    ("C17", "C20"))
def c20z(spark, sf):
    # price first, then o_orderkey with bounds from the surviving rows
    return CL.remove_outliers(hold(dirty_orders(spark, sf)), ["price", "o_orderkey"], "zscore", threshold=3)


@query("c15_fix_types_wide", "select " + ", ".join(
    f"case when l_orderkey % {i + 2} = 0 then null else l_orderkey * {i + 1} end as c{i}" for i in range(20)) + ", " + ", ".join(
    f"cast(l_shipdate as timestamp) + interval '{i} minutes' as d{i}" for i in range(5)) + " from lineitem", ("C15",))
def c15w(spark, sf):
    # 25 text columns: whole numbers with gaps, and dates with minutes
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    li = spread(li, li.count())
    key = F.col("l_orderkey")
    numbers = [F.when(key % (i + 2) != 0, (key * (i + 1)).cast("string")).alias(f"c{i}") for i in range(20)]
    dates = [F.date_format(F.col("l_shipdate") + F.expr(f"interval {i} minutes"), "yyyy-MM-dd HH:mm").alias(f"d{i}") for i in range(5)]
    return CL.fix_types(li.select(*numbers, *dates))[0]
