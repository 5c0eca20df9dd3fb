import numpy as np
import pandas as pd
import pytest

from tablewright.operators import chartdata as D


def test_bar_drops_null_group_and_counts_null_values(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", None)], "k string, v double")
    mean = {r.k: r.v for r in D.bar(df, "k", "v", "mean").collect()}
    assert mean == {"a": 1.0}
    cnt = {r.k: r.v for r in D.bar(df, "k", "v", "count").collect()}
    assert cnt == {"a": 2}


def test_bar_fallback_and_color_dropped(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "k string, s string, c int")
    out = D.bar(df, "k", "s", "mean", color="c")
    assert out.columns == ["k", "count"]


def test_bar_first_needs_order(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 1)], "k string, v double, o int")
    with pytest.raises(ValueError):
        D.bar(df, "k", "v", "first")
    assert D.bar(df, "k", "v", "first", order_by="o").collect()[0].v == 5.0


def test_pie_other(spark):
    rows = [(f"v{i:02d}",) for i in range(11) for _ in range(i + 1)]
    df = spark.createDataFrame(rows, "x string")
    out = {r.x: r["count"] for r in D.pie(df, "x", 10).collect()}
    assert len(out) == 10 and out["Other"] == 1 + 2
    df10 = spark.createDataFrame([(f"v{i}",) for i in range(10)], "x string")
    assert D.pie(df10, "x", 10).count() == 10


def test_histogram_counts_sum(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(0, 1, 500)
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    h = D.histogram(df, "x", 12).collect()
    assert sum(r["count"] for r in h) == 500
    assert max(r.bin for r in h) == 12 and min(r.bin for r in h) == 1


def test_correlation_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, None, 6.0], "b": [2.0, 1.0, None, 3.0, 5.0, 7.0],
                        "c": [None, 1.0, 2.0, 2.5, 4.0, 3.0]})
    df = spark.createDataFrame(pdf)
    got = {(r.col_x, r.col_y): r.corr for r in D.correlation(df).collect()}
    exp = pdf.corr()
    for a in "abc":
        for b in "abc":
            assert got[(a, b)] == pytest.approx(exp.loc[a, b])


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "y double")
    r = D.box_stats(df, "y").collect()[0]
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert r.q1 == q1 and r.q3 == q3 and r.whisker_high == 5.0 and r.whisker_low == 1.0
    out = D.box_outliers(df, "y").collect()
    assert [x.y for x in out] == [100.0]


def test_line_requires_sortable_x(spark):
    df = spark.createDataFrame([("a", 1.0)], "s string, v double")
    with pytest.raises(ValueError):
        D.line(df, "s", "v")


def test_checks_and_unknown_type(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError):
        D.chart_data(df, "histogram", "nope")
    with pytest.raises(ValueError):
        D.chart_data(df, "sunburst", "x")
    assert D.check_plot_columns(df, "x", "y", "nope") is None


def test_violin_density_integrates_to_about_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 2000)], "y double")
    d = sorted((r.k, r.grid_value, r.density) for r in D.violin_density(df, "y", grid_points=64).collect())
    xs = np.array([g for _, g, _ in d])
    ys = np.array([v for _, _, v in d])
    assert 0.9 < np.trapezoid(ys, xs) < 1.05


def test_correlation_of_many_columns_takes_two_jobs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 1, (3000, 100)) + rng.normal(0, 1, (3000, 1))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7] = 3.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(100)])
    df = spark.createDataFrame(pdf).repartition(5)
    spark.sparkContext.setJobGroup("corr", "corr")
    got = D.correlation(df).toPandas().pivot(index="col_x", columns="col_y", values="corr")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("corr")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 4  # AQE runs the stages of one query as jobs of their own; one collect and the small result
    want = pdf.corr().loc[got.index, got.columns]
    assert np.allclose(got.to_numpy(float), want.to_numpy(), atol=1e-9, equal_nan=True)


def test_box_and_violin_leave_missing_values_and_groups_out(spark):
    nan = float("nan")
    rows = [(1.0, float(v), "r") for v in [1, 2, 3, 4, 100]] + [(1.0, nan, "r"), (nan, 5.0, "r"), (None, 6.0, "r"), (1.0, None, "r")]
    df = spark.createDataFrame(rows, "`g.x` double, value double, v string")
    assert [tuple(r) for r in D.box_outliers(df, "value", "g.x").collect()] == [(1.0, 100.0)]
    box = D.box_stats(df, "value", "g.x", "v").collect()
    assert len(box) == 1 and box[0]["n"] == 5 and box[0]["median"] == 3.0
    violin = D.chart_data(df, "violin", "g.x", "value", "v")
    assert violin.columns == ["g.x", "v", "k", "grid_value", "density"] and violin.count() == 16
    assert D.violin_box(df, "value", "g.x", "v").collect()[0]["q3"] == 4.0
