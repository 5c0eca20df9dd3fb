"""Clustering queries.

SQL-checked forms use fixed centres in standardised space, so assignment,
sizes, summaries and inertia are deterministic; the K-means fit itself is
checked on rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import cluster as CU
from .fixtures import dirty_orders, table, with_dirty
from .registry import query

ORDER_FEATS = ["o_totalprice", "o_custkey"]
CENTRES = [[-1.0, -1.0], [0.0, 0.0], [1.0, 1.0]]


def _round(df, scale=6):
    return df.select(*[X.round_half_up(F.col(f.name), scale).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def _assigned(spark, sf):
    o = table(spark, sf, "orders")
    scaled, params, _ = CU.scaled_frame(o, ORDER_FEATS, ["o_orderkey"])
    return CU.assign(scaled, ORDER_FEATS, CENTRES), params


ASSIGN_SQL = """
with s as (select o_orderkey, o_totalprice, o_custkey,
                  coalesce((o_totalprice - avg(o_totalprice) over ()) / nullif(stddev_pop(o_totalprice) over (), 0), 0) as a,
                  coalesce((o_custkey - avg(o_custkey) over ()) / nullif(stddev_pop(o_custkey) over (), 0), 0) as b
           from orders),
c as (select * from (values (0, -1.0, -1.0), (1, 0.0, 0.0), (2, 1.0, 1.0)) t(cluster, ca, cb)),
d as (select s.*, c.cluster, (a - ca) * (a - ca) + (b - cb) * (b - cb) as dist2,
             row_number() over (partition by o_orderkey order by (a - ca) * (a - ca) + (b - cb) * (b - cb), c.cluster) as rn
      from s, c),
asg as (select o_orderkey, o_totalprice, o_custkey, cast(cluster as int) as cluster, dist2 from d where rn = 1)
"""


@query("f02_impute_and_scale", with_dirty(
    "m as (select quantile_cont(price, 0.5) as med from dirty),\n"
    "f as (select o_orderkey, coalesce(price, med) as price from dirty, m)\n"
    "select o_orderkey, round(price, 4) as price, "
    "round(coalesce((price - avg(price) over ()) / nullif(stddev_pop(price) over (), 0), 0), 6) as price_scaled from f"),
    ("F2", "F3"))
def f02(spark, sf):
    scaled, _, _ = CU.scaled_frame(dirty_orders(spark, sf), ["price"], ["o_orderkey"])
    return scaled.select("o_orderkey", X.round_half_up("price", 4).alias("price"),
                         X.round_half_up(CU.SCALED + "price", 6).alias("price_scaled"))


@query("f03_standard_scaling", """
select c_custkey,
       round(coalesce((c_acctbal - avg(c_acctbal) over ()) / nullif(stddev_pop(c_acctbal) over (), 0), 0), 6) as c_acctbal,
       round(coalesce((c_nationkey - avg(c_nationkey) over ()) / nullif(stddev_pop(c_nationkey) over (), 0), 0), 6) as c_nationkey
from customer""", ("F3", "H8"))
def f03(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double"),
                                            F.col("c_nationkey").cast("double"))
    scaled, _ = CU.FE.standard_scale(c, ["c_acctbal", "c_nationkey"])
    return _round(scaled)


@query("f07_nearest_centre", ASSIGN_SQL + "select o_orderkey, cluster, round(dist2, 6) as dist2 from asg", ("F7",))
def f07(spark, sf):
    a, _ = _assigned(spark, sf)
    return a.select("o_orderkey", "cluster", X.round_half_up("dist2", 6).alias("dist2"))


@query("f08_centres_original", """
with p as (select avg(o_totalprice) mt, stddev_pop(o_totalprice) st, avg(o_custkey) mc, stddev_pop(o_custkey) sc from orders),
c as (select * from (values (0, -1.0, -1.0), (1, 0.0, 0.0), (2, 1.0, 1.0)) t(cluster, ca, cb))
select cast(cluster as int) as cluster, 'o_totalprice' as feature, round(ca * st + mt, 4) as value from c, p
union all select cast(cluster as int), 'o_custkey', round(cb * sc + mc, 4) from c, p""", ("F8",))
def f08(spark, sf):
    _, params = _assigned(spark, sf)
    out = CU.centres_original(CENTRES, ORDER_FEATS, params, spark)
    return out.select("cluster", "feature", X.round_half_up("value", 4).alias("value"))


@query("f09_cluster_sizes", ASSIGN_SQL + """,
k as (select * from range(0, 3) t(cluster)),
n as (select cluster, count(*) as size from asg group by cluster)
select cast(k.cluster as int) as cluster, coalesce(n.size, 0) as size,
       round_even(coalesce(n.size, 0) / (select count(*) from asg) * 100, 2) as percentage
from k left join n on k.cluster = n.cluster""", ("F9",))
def f09(spark, sf):
    a, _ = _assigned(spark, sf)
    return CU.cluster_sizes(a, 3)


@query("f10_cluster_summary", ASSIGN_SQL + " union all ".join(
    f"""select cluster, '{c}' as column_name, count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
        round(min({c}), 4) as min, round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50,
        round(quantile_cont({c}, 0.75), 4) as q75, round(max({c}), 4) as max from asg group by cluster"""
    for c in ORDER_FEATS), ("F10",))
def f10(spark, sf):
    a, _ = _assigned(spark, sf)
    return _round(CU.cluster_summary(a, ORDER_FEATS), 4)


@query("f11_inertia", ASSIGN_SQL + "select round(sum(dist2), 4) as inertia from asg", ("F11",))
def f11(spark, sf):
    a, _ = _assigned(spark, sf)
    return CU.inertia(a).select(X.round_half_up("inertia", 4).alias("inertia"))


@query("f12_join_labels", ASSIGN_SQL + "select o.*, asg.cluster from orders o join asg using (o_orderkey)", ("F12",))
def f12(spark, sf):
    a, _ = _assigned(spark, sf)
    return CU.join_labels(table(spark, sf, "orders"), a, "o_orderkey")


def _kmeans(spark, sf):
    return CU.kmeans(table(spark, sf, "customer"), "c_custkey", k=3, features=["c_acctbal", "c_nationkey"])


@query("f05_kmeans", None, ("F5", "F1", "F4"))
def f05(spark, sf):
    r = _kmeans(spark, sf)
    return r.assignments.select("c_custkey", "cluster", "dist2")


@query("f06_cluster_assignments", None, ("F6",))
def f06(spark, sf):
    r = _kmeans(spark, sf)
    return r.assignments.select("c_custkey", *[CU.SCALED + c for c in r.features], "cluster")


@query("f09_kmeans_sizes", None, ("F9",))
def f09k(spark, sf):
    return _kmeans(spark, sf).sizes()


@query("f13_cluster_scatter", None, ("F13",))
def f13(spark, sf):
    return _kmeans(spark, sf).scatter()
