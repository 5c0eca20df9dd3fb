"""Profile queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import profile as P
from .fixtures import dirty_orders, table, with_dirty
from .registry import query

DIRTY_COLS = ["o_orderkey", "price", "priority", "cust_txt", "date_txt", "sparse_status"]


@query("b01_overview_lineitem", """
select count(*) as n_rows, 11 as n_columns,
       cast(sum(68 + strlen(l_returnflag) + strlen(l_linestatus)) as bigint) as logical_bytes
from lineitem""", ("B1", "B7"))
def b01(spark, sf):
    return P.overview(table(spark, sf, "lineitem"))


@query("b07_logical_bytes_documents", """
select count(*) as n_rows, 5 as n_columns,
       cast(sum(16 + strlen(text) + strlen(lang) + strlen(source)) as bigint) as logical_bytes
from documents""", ("B7",))
def b07(spark, sf):
    return P.overview(table(spark, sf, "documents"))


@query("b07_logical_bytes_embeddings", """
select count(*) as n_rows, 3 as n_columns,
       cast(sum(8 + 4 * len(embedding) + 4) as bigint) as logical_bytes
from embeddings""", ("B7",))
def b07e(spark, sf):
    return P.overview(table(spark, sf, "embeddings"))


@query("b02_column_types", """
select cast(ordinal_position - 1 as int) as position, column_name,
       case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
                      when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else lower(data_type) end
         as data_type
from information_schema.columns where table_name = 'orders'""", ("B2",))
def b02(spark, sf):
    return P.column_types(table(spark, sf, "orders"))


def _missing_sql(select: str) -> str:
    u = " union all ".join(
        f"select '{c}' as column_name, cast(count(*) - count({c}) as bigint) as n_missing, count(*) as n_rows from dirty"
        for c in DIRTY_COLS)
    return with_dirty(f"u as ({u}),\nm as (select column_name, n_missing, "
                      f"round_even(n_missing / n_rows * 100, 2) as missing_pct from u)\n" + select)


@query("b03_missing_values", _missing_sql("select * from m"), ("B3", "B4", "H5"))
def b03(spark, sf):
    return P.missing_table(dirty_orders(spark, sf))


@query("b05_missing_sorted", _missing_sql(
    "select column_name, missing_pct, cast(row_number() over (order by missing_pct desc, column_name) as int) as sort_rank from m"),
    ("B5",))
def b05(spark, sf):
    m = P.missing_table(dirty_orders(spark, sf))
    # one row per column: a global window over this tiny table is fine
    return m.select("column_name", "missing_pct",
                    F.row_number().over(Window.orderBy(F.desc("missing_pct"), "column_name")).alias("sort_rank"))


@query("b06_duplicate_rows", with_dirty(
    "select cast((select count(*) from dirty) - (select count(*) from (select distinct * from dirty)) "
    "as bigint) as duplicate_rows"), ("B6",))
def b06(spark, sf):
    return P.duplicate_rows(dirty_orders(spark, sf))


LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]


def _summary_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"select '{c}' as column_name, count({c}) as count, round_even(avg({c}), 2) as mean, "
            f"round_even(stddev_samp({c}), 2) as std, round_even(min({c}), 2) as min, "
            f"round_even(quantile_cont({c}, 0.25), 2) as q25, round_even(quantile_cont({c}, 0.5), 2) as q50, "
            f"round_even(quantile_cont({c}, 0.75), 2) as q75, round_even(max({c}), 2) as max from {tbl}")
    return " union all ".join(parts)


@query("b08_numeric_summary", _summary_sql("lineitem", LINEITEM_NUM), ("B8", "B9", "H10"))
def b08(spark, sf):
    return P.numeric_summary(table(spark, sf, "lineitem"), LINEITEM_NUM, decimals=2)


@query("b08_numeric_summary_customer", _summary_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
       ("B8", "B9"))
def b08c(spark, sf):
    return P.numeric_summary(table(spark, sf, "customer"), decimals=2)


def _cat_sql(tbl: str, cols: list[str]) -> str:
    vc = " union all ".join(
        f"select '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from {tbl} "
        f"where {c} is not null group by {c}" for c in cols)
    return f"with vc as ({vc})\n"


@query("b10_categorical_summary", _cat_sql("part", ["p_name", "p_brand", "p_type"]) +
       "select column_name, count(*) as unique_values, count(distinct n) as distinct_frequencies "
       "from vc group by column_name", ("B10",))
def b10(spark, sf):
    return P.categorical_summary(table(spark, sf, "part"))


@query("b10_categorical_summary_documents", _cat_sql("documents", ["text", "lang", "source"]) +
       "select column_name, count(*) as unique_values, count(distinct n) as distinct_frequencies "
       "from vc group by column_name", ("B10",))
def b10d(spark, sf):
    return P.categorical_summary(table(spark, sf, "documents"))


@query("b11_top_values", _cat_sql("part", ["p_name", "p_brand", "p_type"]) +
       ", r as (select *, cast(row_number() over (partition by column_name order by n desc, value) as int) as rank from vc)\n"
       "select column_name, rank, value, n from r where rank <= 5", ("B11",))
def b11(spark, sf):
    return P.top_values(table(spark, sf, "part"), k=5)


@query("b11_top_values_orders", _cat_sql("orders", ["o_orderstatus", "o_orderpriority"]) +
       ", r as (select *, cast(row_number() over (partition by column_name order by n desc, value) as int) as rank from vc)\n"
       "select column_name, rank, value, n from r where rank <= 5", ("B11",))
def b11o(spark, sf):
    return P.top_values(table(spark, sf, "orders"), k=5)


@query("b12_profile_json", None, ("B12", "A8"))
def b12(spark, sf):
    return P.profile(dirty_orders(spark, sf)).to_json()
