"""Source, view and user-computation queries."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators import clean as CL
from ..functions.columns import NULL_TOKENS
from ..operators import transform as TR
from ..session import ensure_checkpoint_dir
from ..sources import csv as CSV
from ..sources.dataset import Dataset, compare, head, tail
from .fixtures import dirty_orders, table, with_dirty
from .registry import query


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a01_csv_source", with_dirty(
    "select o_orderkey, price, priority, "
    "cast(case when cust_txt = 'n/a' then null else cust_txt end as bigint) as cust_txt, date_txt, sparse_status from dirty"),
    ("A1",))
def a01(spark, sf):
    path = _scratch(spark, "csv-dirty-orders")
    # NULLs are written as the token NA; 'n/a' in cust_txt is another null token
    dirty_orders(spark, sf).write.option("header", True).option("nullValue", "NA").csv(path)
    return CSV.read_csv(spark, path)


def _tokens_sql() -> str:
    return ", ".join(f"'{t}'" for t in NULL_TOKENS)


@query("a01_csv_quoted", "select doc_id, case when trim(text, ' ') in (" + _tokens_sql() + ") then null else text end as text, "
       "lang, source, n_chars from documents", ("A1",))
def a01q(spark, sf):
    # texts hold line breaks, quotes, separators and white space at their ends
    path = _scratch(spark, "csv-documents")
    (table(spark, sf, "documents").write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return CSV.read_csv(spark, path)


@query("a01_csv_long_ints", "select o_orderkey, 9000000000000000000 + o_orderkey as \"id.long\", "
       "cast(cast('12345678901234567890123' || lpad(cast(o_orderkey as varchar), 12, '0') as decimal(38,0)) as varchar) as huge, "
       "o_totalprice from orders", ("A1",))
def a01i(spark, sf):
    path = _scratch(spark, "csv-long-ints")
    key = F.col("o_orderkey")
    (table(spark, sf, "orders").select(key, (F.lit(9000000000000000000) + key).alias("id.long"),
                                       F.concat(F.lit("12345678901234567890123"), F.lpad(key.cast("string"), 12, "0")).alias("huge"), "o_totalprice")
     .write.option("header", True).csv(path))
    read = CSV.read_csv(spark, path)
    if read.schema["huge"].dataType.simpleString() != "decimal(38,0)":
        raise ValueError(f"huge was read as {read.schema['huge'].dataType.simpleString()}")
    return read.withColumn("huge", F.col("huge").cast("string"))


@query("a02_head", "select * from orders order by o_orderkey limit 5", ("A2",))
def a02(spark, sf):
    return head(table(spark, sf, "orders"), 5, "o_orderkey")


@query("a03_tail", "select * from (select * from orders order by o_orderkey desc limit 5)", ("A3",))
def a03(spark, sf):
    return tail(table(spark, sf, "orders"), 5, "o_orderkey")


@query("a06_cleaned_view", with_dirty("select distinct * from dirty"), ("A4", "A5", "A6"))
def a06(spark, sf):
    ds = Dataset(dirty_orders(spark, sf))
    cleaned, _ = CL.clean(ds.original, {"drop_duplicates": True})
    return ds.with_cleaned(cleaned).active


@query("a07_change_detection", with_dirty(
    "select 'removed' as side, (select count(*) from (select * from dirty except all "
    "select distinct * from dirty)) as n_rows, false as schema_changed union all "
    "select 'added', (select count(*) from (select distinct * from dirty except all select * from dirty)), false"),
    ("A7",))
def a07(spark, sf):
    d = dirty_orders(spark, sf)
    return compare(d, CL.drop_duplicates(d))


@query("g01_transform_value_counts", "select event_type, count(*) as count from events group by event_type",
       ("G1",))
def g01(spark, sf):
    # the reference's default snippet: value counts of one column
    return TR.transform(table(spark, sf, "events"), lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("count")))


def _props_k(pdf: pd.DataFrame) -> pd.DataFrame:
    ks = [json.loads(p).get("k") if p is not None else None for p in pdf["props"]]
    return pd.DataFrame({"event_id": pdf["event_id"], "k": pd.array(ks, dtype="Int64"),
                         "value_x2": pdf["value"] * 2})


@query("g02_map_batches", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, value * 2 as value_x2 "
       "from events", ("G2",))
def g02(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props", "value")
    return TR.map_batches(ev, _props_k, "event_id long, k long, value_x2 double")


def _partial_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    v = pdf["value"].dropna()
    mean = float(v.mean()) if len(v) else 0.0
    return pd.DataFrame({"event_type": [pdf["event_type"].iloc[0]], "n": [len(v)], "mean": [mean], "m2": [float(((v - mean) ** 2).sum())]})


def _merge_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    n = int(pdf["n"].sum())
    mean = float((pdf["n"] * pdf["mean"]).sum() / n) if n else 0.0
    m2 = float((pdf["m2"] + pdf["n"] * (pdf["mean"] - mean) ** 2).sum())
    return pd.DataFrame({"event_type": [pdf["event_type"].iloc[0]], "n": [n], "mean": [mean], "m2": [m2]})


def _combine_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    one = _merge_moments(pdf).iloc[0]
    return pd.DataFrame({"event_type": [one["event_type"]], "n": [int(one["n"])], "mean": [round(one["mean"], 6) if one["n"] else None],
                         "std": [round((one["m2"] / (one["n"] - 1)) ** 0.5, 6) if one["n"] > 1 else None]})


@query("g03_grouped_pandas", "select event_type, count(value) as n, round(avg(value), 6) as mean, "
       "round(stddev_samp(value), 6) as std from events group by event_type", ("G3",))
def g03(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    return TR.grouped_pandas(ev, ["event_type"], _partial_moments, _combine_moments, "event_type string, n long, mean double, m2 double",
                             "event_type string, n long, mean double, std double", merge=_merge_moments)


@query("g04_sql_view", "select event_type, count(*) as n, round(avg(value), 6) as avg_value from events "
       "group by event_type", ("G4",))
def g04(spark, sf):
    ds = Dataset(table(spark, sf, "events"))
    return TR.sql(spark, "select event_type, count(*) as n, round(avg(value), 6) as avg_value from {df} "
                  "group by event_type", df=ds.active)


@query("g05_change_report", "select 'changed' as status, 'removed' as side, "
       "(select count(*) from events where event_type = 'error') as n_rows union all "
       "select 'changed', 'added', 0", ("G5",))
def g05(spark, sf):
    ev = table(spark, sf, "events")
    out, status, diff = TR.run_user_code(ev, lambda d: d.where(F.col("event_type") != "error"))
    return diff.select(F.lit(status).alias("status"), "side", "n_rows")
