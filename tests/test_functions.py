import datetime as dt
import math

from tablewright.functions import columns as X


def test_parse_number_guard(spark):
    vals = [" 12 ", "1e5", "+5", "-.5", "1d", "1_000", "1,000", "nan", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(X.parse_number("s")).collect()]
    assert got[:4] == [12.0, 100000.0, 5.0, -0.5]
    assert got[4:] == [None] * 6


def test_date_pattern_and_parse(spark):
    df = spark.createDataFrame([("2020-01-02",), ("2020-1-3",), ("13/01/2020",), ("hello",), (None,)], "s string")
    rows = df.select(X.looks_like_date("s").alias("m"), X.parse_date("s").alias("d")).collect()
    assert [r.m for r in rows] == [True, True, True, False, None]
    assert rows[0].d == dt.datetime(2020, 1, 2)
    assert rows[1].d == dt.datetime(2020, 1, 3)
    assert rows[2].d == dt.datetime(2020, 1, 13)   # month-first fails, day-first parses
    assert rows[3].d is None


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    n = df.where(X.missing("x", df.schema["x"].dataType)).count()
    assert n == 2


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (50.0,), (3.0,)], "x double")
    got = [r[0] for r in df.select(X.clip("x", 0.0, 10.0)).collect()]
    assert got == [0.0, None, 10.0, 3.0]


def test_fill_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    got = [r[0] for r in df.select(X.fill("x", 9.0, df.schema["x"].dataType)).collect()]
    assert got == [9.0, 9.0, 2.0]


def test_whole_and_round_half_even(spark):
    df = spark.createDataFrame([(2.0,), (2.5,), (0.125,)], "x double")
    rows = df.select(X.is_whole("x").alias("w"), X.round_half_even("x", 2).alias("r")).collect()
    assert [r.w for r in rows] == [True, False, False]
    assert rows[2].r == 0.12


def test_date_parts_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 7),)], "t timestamp_ntz")
    rows = df.select(*X.date_parts("t", "t")).collect()
    assert rows[0].t_dayofweek == 0 and rows[1].t_dayofweek == 6
    assert (rows[0].t_year, rows[0].t_month, rows[0].t_day) == (2024, 1, 1)


def test_standard_score_zero_std(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(X.standard_score("x", 2.0, 0.0)).collect()] == [0.0, 0.0]
    assert not math.isnan(0.0)
