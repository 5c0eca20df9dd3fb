"""Scalar function queries (H1-H10), one column expression each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from .fixtures import dirty_orders, table, with_dirty
from .registry import query

NUM = X.NUMBER_PATTERN
DATE_RE = X.DATE_PATTERN
# DuckDB spellings of the date formats, in the same order
DUCK_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y",
                "%m/%d/%y", "%d/%m/%Y", "%d-%m-%Y", "%d/%m/%y"]


@query("h01_parse_number", with_dirty(
    f"select o_orderkey, case when regexp_matches(trim(cust_txt), '{NUM}') "
    "then try_cast(trim(cust_txt) as double) end as value from dirty"), ("H1",))
def h01(spark, sf):
    return dirty_orders(spark, sf).select("o_orderkey", X.parse_number("cust_txt").alias("value"))


@query("h02_parse_date", with_dirty(
    "select o_orderkey, coalesce(" + ", ".join(
        f"try_strptime(trim(date_txt), '{f}')" for f in DUCK_FORMATS) + ") as value from dirty"), ("H2",))
def h02(spark, sf):
    return dirty_orders(spark, sf).select("o_orderkey", X.parse_date("date_txt").alias("value"))


FORMS = [" 10:05", "T7:05", " 10:05:06.25", "T10:05:06.123456", "T10:05:06Z", "T10:05:06+01:30"]
DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query("h02_parse_date_forms", "select o_orderkey, strptime(" + DAY + ", '%Y-%m-%d') + case o_orderkey % 6 "
       "when 0 then interval '10 hours 5 minutes' when 1 then interval '7 hours 5 minutes' "
       "when 2 then interval '10 hours 5 minutes 6.25 seconds' when 3 then interval '10 hours 5 minutes 6.123456 seconds' "
       "when 4 then interval '10 hours 5 minutes 6 seconds' else interval '8 hours 35 minutes 6 seconds' end as value from orders", ("H2",))
def h02f(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"),
                    F.element_at(F.array(*map(F.lit, FORMS)), (F.col("o_orderkey") % 6 + 1).cast("int")))
    return o.select("o_orderkey", X.parse_date(text).alias("value"))


@query("h03_date_pattern", with_dirty(
    f"select o_orderkey, coalesce(regexp_matches(date_txt, '{DATE_RE}'), false) as value from dirty"),
    ("H3",))
def h03(spark, sf):
    return dirty_orders(spark, sf).select("o_orderkey", F.coalesce(X.looks_like_date("date_txt"), F.lit(False)).alias("value"))


@query("h04_clip", "select o_orderkey, greatest(least(o_totalprice, 250000.0), 50000.0) as value from orders", ("H4",))
def h04(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.clip("o_totalprice", 50000.0, 250000.0).alias("value"))


@query("h05_missing", with_dirty(
    "select o_orderkey, price is null or isnan(price) as price_missing, "
    "priority is null as priority_missing from dirty"), ("H5",))
def h05(spark, sf):
    d = dirty_orders(spark, sf)
    return d.select("o_orderkey", X.missing("price", d.schema["price"].dataType).alias("price_missing"),
                    X.missing("priority").alias("priority_missing"))


@query("h06_fill", with_dirty(
    "select o_orderkey, coalesce(price, -1.0) as price, coalesce(priority, 'Unknown') as priority "
    "from dirty"), ("H6",))
def h06(spark, sf):
    d = dirty_orders(spark, sf)
    return d.select("o_orderkey", X.fill("price", -1.0, d.schema["price"].dataType).alias("price"),
                    X.fill("priority", "Unknown").alias("priority"))


@query("h07_is_whole", "select o_orderkey, o_totalprice % 1 = 0 as value from orders", ("H7",))
def h07(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.is_whole("o_totalprice").alias("value"))


@query("h08_standard_score", """
with m as (select avg(c_acctbal) a, stddev_pop(c_acctbal) s from customer)
select c_custkey, round(coalesce((c_acctbal - a) / nullif(s, 0), 0), 6) as value from customer, m""", ("H8",))
def h08(spark, sf):
    c = table(spark, sf, "customer")
    r = c.agg(F.avg("c_acctbal").alias("a"), F.stddev_pop("c_acctbal").alias("s")).collect()[0]
    return c.select("c_custkey", X.round_half_up(X.standard_score("c_acctbal", r["a"], r["s"]), 6).alias("value"))


@query("h09_date_parts", "select event_id, cast(year(ts) as int) as ts_year, cast(month(ts) as int) as ts_month, "
       "cast(day(ts) as int) as ts_day, cast(isodow(ts) - 1 as int) as ts_dayofweek from events", ("H9",))
def h09(spark, sf):
    return table(spark, sf, "events").select("event_id", *X.date_parts("ts", "ts"))


@query("h10_round_half_even", "select o_orderkey, round_even(o_totalprice / 7, 2) as value from orders", ("H10",))
def h10(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.round_half_even(F.col("o_totalprice") / 7, 2).alias("value"))
