"""Empty tables, all-missing columns and single rows through every operator group."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import chartdata as D
from tablewright.operators import clean as CL
from tablewright.operators import profile as P
from tablewright.operators import stats


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "k string, x double, n bigint")


def test_empty_profile(spark, empty):
    prof = P.profile(empty)
    assert prof.overview.collect()[0].n_rows == 0
    assert prof.numeric.count() == 0 or all(r["count"] == 0 for r in prof.numeric.collect())
    assert prof.top_values.count() == 0
    assert prof.to_json().count() == 1


def test_empty_clean(spark, empty):
    out, log = CL.clean(empty)
    assert out.count() == 0
    assert [r.step for r in log.collect()] == ["no_change"]


def test_empty_quantiles_and_charts(spark, empty):
    assert stats.scalar_quantiles(empty, ["x"], [0.5]) == {"x": [None]}
    assert D.histogram(empty, "x").count() == 0
    assert D.pie(empty, "k").count() == 0
    assert D.box_stats(empty, "x").count() == 0


def test_all_missing_column_everywhere(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 3.0)], "x double, y double")
    assert stats.scalar_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [2.0]}
    prof = P.numeric_summary(df).collect()
    assert {r.column_name for r in prof} == {"x", "y"} or {r.column_name for r in prof} == {"y"}
    out, _ = CL.clean(df)
    assert out.count() == 3
    corr = {(r.col_x, r.col_y): r.corr for r in D.correlation(df).collect()}
    assert corr[("x", "y")] is None and corr[("y", "y")] == 1.0


def test_single_row_pipeline(spark):
    df = spark.createDataFrame([("a", 5.0, 1)], "k string, x double, n bigint")
    out, log = CL.clean(df)
    assert out.collect()[0].x == 5.0
    r = P.numeric_summary(df).where(F.col("column_name") == "x").collect()[0]
    assert r.std is None and r.q50 == 5.0
