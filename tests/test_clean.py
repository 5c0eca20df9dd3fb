import json

import pytest
from pyspark.sql import functions as F

from tablewright.functions import columns as X
from tablewright.operators import clean as CL
from tablewright.operators.cache import spread


def test_options_partial_dict_switches_steps_off():
    o = CL.CleanOptions.from_dict({"drop_duplicates": True})
    assert o.drop_duplicates and o.handle_missing == "none" and not o.handle_outliers and not o.fix_datatypes
    d = CL.CleanOptions.from_dict(None)
    assert d.drop_duplicates and d.handle_missing == "median" and d.handle_outliers == "clip" and d.fix_datatypes


def test_options_json_and_unknown_keys():
    o = CL.CleanOptions.from_json(json.dumps({"handle_missing": "MEAN", "bogus": 1}))
    assert o.handle_missing == "mean" and o.extra == {"bogus": 1}
    with pytest.raises(ValueError):
        CL.CleanOptions.from_json("[1, 2]")
    with pytest.raises(ValueError):
        CL.CleanOptions.from_dict({"handle_missing": "guess"})


def test_numeric_threshold_is_strict(spark):
    # 8 of 10 parse: share exactly 0.8 -> not converted
    vals = [str(i) for i in range(8)] + ["x", "y"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    r = CL.detect_types(df).collect()[0]
    assert r.n_numeric == 8 and r.target is None
    # 19 of 20 parse: one new null is below 10 % of the rows -> integer
    vals = [str(i) for i in range(19)] + ["x"]
    r = CL.detect_types(spark.createDataFrame([(v,) for v in vals], "s string")).collect()[0]
    assert r.target == "integer"


def test_date_share_two_thirds_not_converted(spark):
    df = spark.createDataFrame([("2020-01-02",), ("2020-1-3",), ("13/01/2020",)], "s string")
    r = CL.detect_types(df).collect()[0]
    assert r.looks_like_date and r.target is None  # best single format parses 2 of 3


def test_float_narrowing(spark):
    df = spark.createDataFrame([("1.5",), ("2",), ("3",)], "s string")
    out, conv = CL.fix_types(df)
    assert conv == [("s", "double")] and dict(out.dtypes)["s"] == "double"


def test_sequential_removal_uses_survivors(spark):
    rows = [(float(i), float(i % 5)) for i in range(40)] + [(1000.0, 2.0), (5.0, 100.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    out = CL.remove_outliers(df, ["a", "b"])
    got = sorted((r.a, r.b) for r in out.collect())
    assert (1000.0, 2.0) not in got and (5.0, 100.0) not in got and len(got) == 40


def test_null_row_survives_removal(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,), (1000,)], "x bigint")
    out = CL.remove_outliers(df, ["x"])
    assert sorted(out.collect(), key=lambda r: (r.x is None, r.x))[-1].x is None
    assert out.count() == 5


def test_clip_makes_double_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,), (1000,)], "x bigint")
    b = CL.outlier_bounds(df, ["x"])
    out = CL.clip_outliers(df, b)
    assert dict(out.dtypes)["x"] == "double"
    vals = [r.x for r in out.collect()]
    assert None in vals and max(v for v in vals if v is not None) < 1000


def test_one_row_no_outliers(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    b = CL.outlier_bounds(df, ["x"], "zscore")
    assert b["x"] == (None, None)
    assert CL.count_outliers(df, b) == {"x": 0}


def test_all_null_fill(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    out, log = CL.clean(df, {"handle_missing": "mode"})
    assert [tuple(r) for r in out.collect()] == [(0.0, "Unknown"), (0.0, "Unknown")]
    out, log = CL.clean(df, {"handle_missing": "mean"})
    assert [r.x for r in out.collect()] == [None, None]
    logged = {r.column_name: r.n_affected for r in log.collect() if r.step == "fill_numeric"}
    assert logged == {"x": 0}


def test_clean_twice_is_stable_for_dedupe_and_constant_fill(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "x bigint, s string")
    opts = {"drop_duplicates": True, "handle_missing": "fill"}
    once, _ = CL.clean(df, opts)
    twice, _ = CL.clean(once, opts)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_boolean_columns_left_alone(spark):
    df = spark.createDataFrame([(True, None), (None, "x")], "flag boolean, s string")
    out, _ = CL.clean(df, {"handle_missing": "median"})
    assert [r.flag for r in out.collect()] == [True, None]


def test_default_pipeline_on_dirty_view(spark):
    from tests.conftest import SF_SMALL
    from tablewright.plans.fixtures import dirty_orders
    out, log = CL.clean(dirty_orders(spark, SF_SMALL))
    steps = [r.step for r in log.collect()]
    assert steps[0] == "drop_duplicates" and "clip_outliers" in steps
    assert out.where(F.col("price").isNull()).count() == 0
    assert dict(out.dtypes)["date_txt"] == "timestamp_ntz"


def test_outlier_exclude_keeps_id_column(spark):
    rows = [(i, float(i % 7)) for i in range(50)] + [(10_000, 3.0)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    out, log = CL.clean(df, {"handle_outliers": "clip", "outlier_exclude": ["id"]})
    assert dict(out.dtypes)["id"] == "bigint" and out.agg(F.max("id")).collect()[0][0] == 10_000


def test_drop_cols_strategy_through_pipeline(spark):
    rows = [(i, None if i % 4 else "x", float(i)) for i in range(20)]   # s is 75 % missing
    df = spark.createDataFrame(rows, "k int, s string, v double")
    out, log = CL.clean(df, {"handle_missing": "drop_cols"})
    assert out.columns == ["k", "v"]
    assert [(r.step, r.column_name) for r in log.collect()] == [("drop_sparse_column", "s")]


def test_approx_quantile_option_close_to_exact(spark):
    rows = [(float(i % 97) + (500.0 if i % 50 == 0 else 0.0),) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double")
    exact = CL.outlier_bounds(df, ["x"], "iqr")["x"]
    approx = CL.outlier_bounds(df, ["x"], "iqr", quantile_method="approx")["x"]
    assert abs(exact[0] - approx[0]) < 5 and abs(exact[1] - approx[1]) < 5
    out, log = CL.clean(df, {"handle_outliers": "clip", "quantile_method": "approx"})
    assert out.agg(F.max("x")).collect()[0][0] <= approx[1] + 1e-9


def test_formats_are_tried_by_their_separators(spark):
    """Every format has one signature or, with a zone, three; counts agree with trying every format on every value."""
    texts = ["1998-2-6 00:03:01", "1998-02-06T1:2:3", "1998-2-6", "1998/2/6", "12/31/1998", "12-31-1998", "1/2/98", "31/12/1998", "31-12-1998",
             " 31/12/98 ", "1998-2-6 0:3", "1998-2-6T0:3", "1998-2-6 0:3:1.5", "1998-2-6T0:3:1.25", "1998-2-6T0:3:1Z", "1998-2-6T0:3:1+01:00",
             "1998-2-6T0:3:1-01:00", "on 1998-2-6", "1998-13-45", "x", "-5", "1e-5", "1234-5", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    (r,) = CL.detect_types(df).collect()
    want = df.agg(F.count_if(X.looks_like_date("v")).alias("d"), F.count(X.parse_number("v")).alias("p"),
                  *(F.count(X.parse_date_with("v", f)).alias(f) for f in X.DATE_FORMATS)).first()
    best = max(X.DATE_FORMATS, key=lambda f: (want[f], -X.DATE_FORMATS.index(f)))
    assert (r["looks_like_date"], r["n_numeric"], r["best_date_format"], r["n_dates"]) == (want["d"] > 0, want["p"], best, want[best])
    for f in X.DATE_FORMATS:
        (alone,) = CL.detect_types(df, formats=(f,)).collect()
        assert alone["n_dates"] == want[f] > 0
        assert len(X.date_signatures(f)) == (3 if f.endswith("XXX") else 1)


def test_many_rows_of_one_partition_are_dealt_out(spark):
    df = spark.range(1000, numPartitions=1)
    assert spread(df, 1000, 300).rdd.getNumPartitions() == 4 and spread(df, 1000, 1000) is df
    assert {r["id"] for r in spread(df, 1000, 300).collect()} == set(range(1000))
