"""Inputs derived by Spark from the supplied tables.

The supplied tables have no missing values and no duplicate rows, so the
cleaning and null-aware profiling operators run over a *dirty view* of
``orders`` whose dirt follows fixed key rules (every row of ``orders`` is
kept, some rows appear twice).  The same rules are given as DuckDB SQL for
the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    b = o.select(
        k,
        F.when(k % 7 == 0, F.lit(None)).when(k % 50 == 1, F.col("o_totalprice") * 20)
         .otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 40 == 3, F.lit("n/a")).when(k % 13 == 0, F.lit(None))
         .otherwise(F.col("o_custkey").cast("string")).alias("cust_txt"),
        F.when(k % 45 == 2, F.lit("unknown"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_txt"),
        F.when(k % 5 < 3, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("sparse_status"),
    )
    return b.unionByName(b.where(k % 20 == 0))


DIRTY_SQL = """
dirty_base as (
  select o_orderkey,
         case when o_orderkey % 7 = 0 then null
              when o_orderkey % 50 = 1 then o_totalprice * 20
              else o_totalprice end as price,
         case when o_orderkey % 11 = 0 then null else o_orderpriority end as priority,
         case when o_orderkey % 40 = 3 then 'n/a'
              when o_orderkey % 13 = 0 then null
              else cast(o_custkey as varchar) end as cust_txt,
         case when o_orderkey % 45 = 2 then 'unknown'
              else strftime(o_orderdate, '%Y-%m-%d') end as date_txt,
         case when o_orderkey % 5 < 3 then null else o_orderstatus end as sparse_status
  from orders),
dirty as (select * from dirty_base union all select * from dirty_base where o_orderkey % 20 = 0)
"""


def with_dirty(sql: str) -> str:
    """Prefix a DuckDB query with the dirty view: ``sql`` is either a plain
    ``select`` or further CTEs (``name as (...), ... select ...``)."""
    body = sql.strip()
    sep = "\n" if body.lower().startswith("select") else ",\n"
    return "with " + DIRTY_SQL.strip() + sep + body
