"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import chartdata as D
from .fixtures import DIRTY_SQL, dirty_orders, table
from .registry import query


def _round(df, scale=6, skip=()):
    return df.select(*[X.round_half_up(F.col(f.name), scale).alias(f.name)
                       if f.dataType.typeName() == "double" and f.name not in skip else F.col(f.name)
                       for f in df.schema.fields])


def _hist_sql(tbl, x, n, color=None):
    c = f"{color}, " if color else ""
    return f"""
with r as (select min({x}) lo, max({x}) hi from {tbl} where {x} is not null),
b as (select {c}cast(case when hi = lo then 1 else least(floor(({x} - lo) / ((hi - lo) / {n})) + 1, {n}) end as int) as bin,
             lo, hi from {tbl}, r where {x} is not null)
select {c}bin, round(lo + (bin - 1) * ((hi - lo) / {n}), 6) as bin_lower, round(lo + bin * ((hi - lo) / {n}), 6) as bin_upper,
       count(*) as count
from b group by {c}bin, lo, hi"""


@query("d01_histogram", _hist_sql("lineitem", "l_extendedprice", 20), ("D1",))
def d01(spark, sf):
    return _round(D.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20))


@query("d01_histogram_color", _hist_sql("lineitem", "l_quantity", 10, "l_returnflag"), ("D1",))
def d01c(spark, sf):
    return _round(D.histogram(table(spark, sf, "lineitem"), "l_quantity", 10, color="l_returnflag"))


@query("d02_scatter", "select * from lineitem", ("D2",))
def d02(spark, sf):
    return D.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", color="l_returnflag")


@query("d03_bar_mean", "select c_mktsegment, round(avg(c_acctbal), 6) as c_acctbal from customer "
       "where c_mktsegment is not null group by c_mktsegment", ("D3",))
def d03(spark, sf):
    return _round(D.bar(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "mean"))


@query("d03_bar_median", "select p_brand, round(quantile_cont(p_retailprice, 0.5), 6) as p_retailprice from part "
       "where p_brand is not null group by p_brand", ("D3",))
def d03m(spark, sf):
    return _round(D.bar(table(spark, sf, "part"), "p_brand", "p_retailprice", "median"))


@query("d03_bar_std", "select o_orderpriority, round(stddev_samp(o_totalprice), 6) as o_totalprice from orders "
       "where o_orderpriority is not null group by o_orderpriority", ("D3",))
def d03s(spark, sf):
    return _round(D.bar(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "std"))


@query("d04_bar_count", "select o_orderpriority, count(*) as o_totalprice from orders "
       "where o_orderpriority is not null group by o_orderpriority", ("D4",))
def d04(spark, sf):
    return D.bar(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "count")


@query("d05_bar_nunique", "select o_orderstatus, count(distinct o_custkey) as o_custkey from orders "
       "where o_orderstatus is not null group by o_orderstatus", ("D5",))
def d05(spark, sf):
    return D.bar(table(spark, sf, "orders"), "o_orderstatus", "o_custkey", "nunique")


@query("d06_bar_fallback_count", "select c_mktsegment, count(*) as count from customer "
       "where c_mktsegment is not null group by c_mktsegment", ("D6", "D16"))
def d06(spark, sf):
    return D.bar(table(spark, sf, "customer"), "c_mktsegment", "c_name", "mean", color="c_nationkey")


@query("d07_value_counts", "select p_type, count(*) as count from part where p_type is not null group by p_type",
       ("D7",))
def d07(spark, sf):
    return D.bar(table(spark, sf, "part"), "p_type")


def _box_sql(tbl, y, g=None):
    gs = f"{g}, " if g else ""
    using = f"join f using ({g})" if g else ", f"
    where = f" and {g} is not null" if g else ""
    grp = f"group by {g}" if g else ""
    return f"""
with b as (select {gs}{y} as y from {tbl} where {y} is not null{where}),
q as (select {gs}quantile_cont(y, 0.25) q1, quantile_cont(y, 0.5) median, quantile_cont(y, 0.75) q3 from b {grp}),
f as (select *, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from q)
select {gs.replace(', ', '')}{', ' if g else ''}round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3,
       round(lower_fence, 6) lower_fence, round(upper_fence, 6) upper_fence, count(*) as n,
       round(min(case when y >= lower_fence then y end), 6) as whisker_low,
       round(max(case when y <= upper_fence then y end), 6) as whisker_high
from b {using} group by {gs}q1, median, q3, lower_fence, upper_fence"""


@query("d08_box_by_group", _box_sql("lineitem", "l_extendedprice", "l_returnflag"), ("D8",))
def d08(spark, sf):
    return _round(D.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("d08_box_single", _box_sql("customer", "c_acctbal"), ("D8",))
def d08s(spark, sf):
    return _round(D.box_stats(table(spark, sf, "customer"), "c_acctbal"))


@query("d09_box_outliers", """
with q as (select o_orderpriority, quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.75) q3
           from orders where o_totalprice is not null and o_orderpriority is not null group by o_orderpriority)
select o.o_orderpriority, o.o_orderkey, o.o_totalprice from orders o join q using (o_orderpriority)
where o.o_totalprice < q1 - 1.5 * (q3 - q1) or o.o_totalprice > q3 + 1.5 * (q3 - q1)""", ("D9",))
def d09(spark, sf):
    return D.box_outliers(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority", keep=["o_orderkey"])


@query("d10_line", "select o_orderdate, o_totalprice from orders", ("D10",))
def d10(spark, sf):
    return D.line(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


def _pie_sql(tbl, x, max_slices=10):
    return f"""
with c as (select cast({x} as varchar) as {x}, count(*) as n from {tbl} where {x} is not null group by {x}),
r as (select *, row_number() over (order by n desc, {x}) as rn, count(*) over () as k from c)
select case when k > {max_slices} and rn > {max_slices - 1} then 'Other' else {x} end as {x}, cast(sum(n) as bigint) as count
from r group by 1"""


@query("d11_pie_topk_other", _pie_sql("part", "p_name"), ("D11",))
def d11(spark, sf):
    return D.pie(table(spark, sf, "part"), "p_name", 10)


@query("d11_pie_no_merge", _pie_sql("customer", "c_mktsegment"), ("D11",))
def d11n(spark, sf):
    return D.pie(table(spark, sf, "customer"), "c_mktsegment", 10)


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    parts = []
    for a in LI_NUM:
        for b in LI_NUM:
            parts.append(f"select '{a}' as col_x, '{b}' as col_y, round(corr({a}, {b}), 6) as corr from lineitem")
    return " union all ".join(parts)


@query("d12_correlation", _corr_sql(), ("D12",))
def d12(spark, sf):
    return _round(D.correlation(table(spark, sf, "lineitem"), LI_NUM))


@query("d13_density_heatmap", """
with r as (select min(l_quantity) xl, max(l_quantity) xh, min(l_extendedprice) yl, max(l_extendedprice) yh from lineitem)
select cast(case when xh = xl then 1 else least(floor((l_quantity - xl) / ((xh - xl) / 10)) + 1, 10) end as int) as bin_x,
       cast(case when yh = yl then 1 else least(floor((l_extendedprice - yl) / ((yh - yl) / 10)) + 1, 10) end as int) as bin_y,
       count(*) as count
from lineitem, r where l_quantity is not null and l_extendedprice is not null group by 1, 2""", ("D13",))
def d13(spark, sf):
    return D.density_heatmap(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 10, 10)


@query("d14_violin_density", """
with b as (select l_returnflag, l_extendedprice as y from lineitem where l_extendedprice is not null and l_returnflag is not null),
c as (select l_returnflag, y, count(*) as w from b group by l_returnflag, y),
g as (select l_returnflag, count(*) as n, stddev_samp(y) sd, min(y) lo, max(y) hi,
             quantile_cont(y, 0.25) q1, quantile_cont(y, 0.75) q3 from b group by l_returnflag),
g2 as (select *, 0.9 * least(sd, (q3 - q1) / 1.34) * pow(n, -0.2) as bw from g),
grid as (select g2.*, cast(t.k as int) as k, lo + t.k * ((hi - lo) / 15) as grid_value from g2, range(0, 16) t(k) where bw > 0)
select grid.l_returnflag, k, round(grid_value, 6) as grid_value,
       round(sum(w * exp(-0.5 * ((grid_value - y) / bw) * ((grid_value - y) / bw))) / (n * bw * sqrt(2 * pi())), 10) as density
from grid join c using (l_returnflag) group by grid.l_returnflag, k, grid_value, n, bw""", ("D14",))
def d14(spark, sf):
    out = D.violin_density(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", 16)
    return out.select("l_returnflag", "k", X.round_half_up("grid_value", 6).alias("grid_value"),
                      X.round_half_up("density", 10).alias("density"))


@query("d09_box_outliers_dirty", """
with """ + DIRTY_SQL.strip() + """,
q as (select priority, quantile_cont(price, 0.25) q1, quantile_cont(price, 0.75) q3
      from dirty where price is not null and priority is not null group by priority)
select d.priority, d.o_orderkey, d.price from dirty d join q using (priority)
where d.price < q1 - 1.5 * (q3 - q1) or d.price > q3 + 1.5 * (q3 - q1)""", ("D9",))
def d09d(spark, sf):
    return D.box_outliers(dirty_orders(spark, sf), "price", "priority", keep=["o_orderkey"])


@query("d02_scatter_sample", "select * from orders where "
       "(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8))::bigint % 10000) < 1000", ("D2",))
def d02s(spark, sf):
    # a deterministic 10 % key-hash sample is the feature here (a chart of a huge table)
    return D.scatter(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", color="o_orderstatus",
                     sample_fraction=0.1, key="o_orderkey")


NAN_ORDERS_SQL = """select case when o_orderkey % 9 = 0 then null else o_orderstatus end as "group.key",
       case when o_orderkey % 17 = 0 then cast('nan' as double) when o_orderkey % 10 = 3 then null else cast(o_orderkey % 10 as double) end as value,
       case when o_orderkey % 19 = 0 then cast('nan' as double) when o_orderkey % 50 = 1 then o_totalprice * 20 else o_totalprice end as v,
       o_orderkey from orders"""


def nan_orders(spark, sf):
    """Orders with missing groups and values, NULL and NaN, under names that operators use themselves."""
    k, nan = F.col("o_orderkey"), F.lit(float("nan"))
    return table(spark, sf, "orders").select(
        F.when(k % 9 != 0, F.col("o_orderstatus")).alias("group.key"),
        F.when(k % 17 == 0, nan).when(k % 10 != 3, (k % 10).cast("double")).alias("value"),
        F.when(k % 19 == 0, nan).when(k % 50 == 1, F.col("o_totalprice") * 20).otherwise(F.col("o_totalprice")).alias("v"), k)


def _nan_box(group):
    return f"""with o as ({NAN_ORDERS_SQL}),
b as (select * from o where {group} is not null and not isnan(v)),
q as (select {group}, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) median, quantile_cont(v, 0.75) q3 from b group by {group}),
f as (select *, q1 - 1.5 * (q3 - q1) lower_fence, q3 + 1.5 * (q3 - q1) upper_fence from q)"""


@query("d09_box_nan", _nan_box('"group.key"') + """
select b."group.key", o_orderkey, v from b join f using ("group.key") where v < lower_fence or v > upper_fence""", ("D9",))
def d09n(spark, sf):
    return D.box_outliers(nan_orders(spark, sf), "v", "group.key", keep=["o_orderkey"])


@query("d08_box_nan_groups", _nan_box("value").replace("value is not null", "value is not null and not isnan(value)") + """
select value, round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3, round(lower_fence, 6) lower_fence, round(upper_fence, 6) upper_fence,
       count(*) as n, round(min(v) filter (v >= lower_fence), 6) as whisker_low, round(max(v) filter (v <= upper_fence), 6) as whisker_high
from b join f using (value) group by all""", ("D8",))
def d08n(spark, sf):
    return _round(D.box_stats(nan_orders(spark, sf), "v", "value"))


@query("d03_bar_dotted_names", f"""select "group.key", round(quantile_cont(v, 0.5), 6) as v from ({NAN_ORDERS_SQL})
where "group.key" is not null and not isnan(v) group by "group.key" """, ("D3",))
def d03n(spark, sf):
    out = D.bar(nan_orders(spark, sf), "group.key", "v", "median")
    return out.toDF("k", "v").select(F.col("k").alias("group.key"), F.round("v", 6).alias("v"))


WIDE = 40


@query("d12_correlation_wide", "with w as (select " + ", ".join(
    f"case when (l_orderkey + {i}) % 11 <> 0 then sin(l_quantity * {i + 1}) * l_discount + l_extendedprice * {i % 5} end as c{i}"
    for i in range(WIDE)) + " from lineitem), l as (" + " union all ".join(
    f"select 'c{i}' as col_x, 'c{j}' as col_y, corr(c{i}, c{j}) as corr from w" for i in range(WIDE) for j in range(WIDE)) + """)
select col_x, col_y, round(corr, 6) as corr from l""", ("D12",))
def d12w(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = [F.when((F.col("l_orderkey") + i) % 11 != 0,
                   F.sin(F.col("l_quantity") * (i + 1)) * F.col("l_discount") + F.col("l_extendedprice") * (i % 5)).alias(f"c{i}") for i in range(WIDE)]
    return D.correlation(li.select(*cols)).withColumn("corr", F.round("corr", 6))


@query("d14_violin_color", """
with b as (select l_returnflag, l_linestatus, l_quantity as y from lineitem where l_returnflag is not null),
g as (select l_returnflag, l_linestatus, count(*) as n, stddev_samp(y) sd, min(y) lo, max(y) hi,
             quantile_cont(y, 0.25) q1, quantile_cont(y, 0.75) q3 from b group by all),
g2 as (select *, 0.9 * least(sd, (q3 - q1) / 1.34) * pow(n, -0.2) as bw from g),
c as (select l_returnflag, l_linestatus, y, count(*) as w from b group by all),
grid as (select g2.*, cast(t.k as int) as k, lo + t.k * ((hi - lo) / 15) as grid_value from g2, range(0, 16) t(k) where bw > 0)
select l_returnflag, l_linestatus, k, round(grid_value, 6) as grid_value,
       round(sum(w * exp(-0.5 * ((grid_value - y) / bw) * ((grid_value - y) / bw))) / (n * bw * sqrt(2 * pi())), 9) as density
from grid join c using (l_returnflag, l_linestatus) group by l_returnflag, l_linestatus, k, grid_value, n, bw""", ("D14",))
def d14c(spark, sf):
    out = D.violin_density(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", color="l_linestatus")
    return out.withColumns({"grid_value": F.round("grid_value", 6), "density": F.round("density", 9)})
