import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import ranking, stats


def _skewed_frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n))
    v = np.round(rng.normal(10, 3, n), 1)
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("most", [5, 1_000_000])
@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.75], [0.0, 0.1, 1.0]])
def test_exact_quantiles_match_numpy_grouped(spark, probs, most):
    # brackets of more than `most` distinct values are divided first
    pdf, df = _skewed_frame(spark)
    q = stats.quantiles(df, ["v"], probs, by=["g"], most=most).collect()
    got = {(r.g, r.prob): r.value for r in q}
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part["v"], p), abs=1e-9)


def test_exact_quantiles_global_many_partitions(spark):
    pdf, df = _skewed_frame(spark, 5000, 2)
    got = stats.scalar_quantiles(df.repartition(7), ["v", "id"], [0.5, 0.9], most=3)
    assert got["v"][0] == pytest.approx(np.quantile(pdf.v, 0.5))
    assert got["id"][1] == pytest.approx(np.quantile(pdf.id, 0.9))


def test_quantiles_ignore_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert stats.scalar_quantiles(df, ["x"], [0.5])["x"] == [2.0]


def test_approx_quantiles_close(spark):
    pdf, df = _skewed_frame(spark)
    got = stats.scalar_quantiles(df, ["v"], [0.5], method="approx")["v"][0]
    assert abs(got - np.median(pdf.v)) < 0.5


def test_running_rank_hot_group(spark):
    pdf, df = _skewed_frame(spark, 4000, 3)
    r = ranking.running_rank(df, ["v", "id"], ["g"], num_partitions=6)
    rows = r.rows.select("g", "id", ranking.CUM).toPandas()
    exp = pdf.sort_values(["g", "v", "id"]).assign(rk=lambda d: d.groupby("g").cumcount() + 1)
    m = rows.merge(exp[["id", "rk"]], on="id")
    assert len(m) == len(pdf)
    assert (m[ranking.CUM] == m["rk"]).all()
    # the hot group (a third of the rows) is spread over several range
    # partitions, none much larger than an average partition (the range
    # bounds come from a sample, hence the tolerance)
    hot = [b[ranking.BLOCK_TOTAL] for b in r.blocks.where(F.col("g") == "hot").collect()]
    assert len(hot) > 1 and max(hot) <= 1.5 * len(pdf) / 6


def test_running_rank_weighted_no_groups(spark):
    df = spark.createDataFrame([(3, 2), (1, 5), (2, 1)], "v int, w int")
    r = ranking.running_rank(df, ["v"], weight="w", num_partitions=3)
    got = sorted((x.v, x[ranking.CUM]) for x in r.rows.collect())
    assert got == [(1, 5), (2, 6), (3, 8)]


def test_modes_ties_smallest(spark):
    df = spark.createDataFrame([(k, x) for k, x in zip("bacab", [2.0, 1.0, 1.0, 2.0, 3.0])], "k string, x double")
    m = {r.column_name: r.mode for r in stats.modes(df, ["k", "x"]).collect()}
    assert m["k"] == "a"
    assert float(m["x"]) == 1.0


def test_null_counts(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "a"), (None, "b")], "x double, s string")
    got = {r.column_name: r.n_missing for r in stats.null_counts(df).collect()}
    assert got == {"x": 2, "s": 1}


@pytest.mark.parametrize("seed", [5, 6])
def test_in_memory_and_distributed_quantiles_identical(spark, seed):
    pdf, df = _skewed_frame(spark, 2500, seed)
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    a = {(r.g, r.prob): r.value for r in stats.quantiles(df, ["v"], probs, by=["g"], most=3).collect()}
    b = {(r.g, r.prob): r.value for r in stats.quantiles(df, ["v"], probs, by=["g"]).collect()}
    assert a == b  # same order statistics and the same interpolation formula, bit for bit


@pytest.mark.parametrize("accuracy, most", [(10_000, 1_000_000), (2, 300)])
def test_selection_with_ties_infinities_and_a_rough_sketch(spark, accuracy, most):
    rng = np.random.default_rng(accuracy)
    values = np.r_[rng.normal(0, 1, 20_000), np.full(15_000, 0.25), [np.inf, -np.inf], rng.integers(0, 5, 3000)]
    pdf = pd.DataFrame({"value": ["hot", "b"] * 10 + ["hot"] * (len(values) - 20), "prob": values})
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.013, 0.5, 0.9997]
    got = stats.quantiles(df, ["prob"], probs, by=["value"], accuracy=accuracy, most=most).toDF("g", "c", "p", "x").collect()
    assert len(got) == 2 * len(probs)
    for r in got:
        own = np.sort(pdf.loc[pdf["value"] == r["g"], "prob"])
        at = r["p"] * (len(own) - 1)
        a, b = own[int(np.floor(at))], own[int(np.ceil(at))]
        want = a + (at - np.floor(at)) * (b - a) if np.isfinite(b - a) else None
        assert want is None or r["x"] == pytest.approx(want, abs=1e-12), (r["g"], r["p"])


def test_selection_moves_few_values(spark):
    """Of 400,000 values in four groups only those near the quartiles pass the second scan."""
    from tablewright.operators import selection
    df = spark.range(0, 400_000, 1, 8).selectExpr("id % 4 as k", "cast(xxhash64(id) as double) as v")
    small = selection._brackets(df, ["k"], [0.25, 0.5, 0.75], selection.ACCURACY)
    rows = selection._counted(df, spark.createDataFrame(small.collect(), small.schema), ["k"], [0.25, 0.5, 0.75], True)
    assert rows.count() < 0.02 * 400_000


def test_odd_column_names(spark):
    df = spark.createDataFrame([("x", 1.0, 2), ("x", 3.0, 4), ("y", None, 6)], "`a.b` string, `v` double, `column_name` int")
    q = stats.quantiles(df, ["v"], [0.5], by=["a.b"]).collect()
    assert [tuple(r) for r in q] == [("x", "v", 0.5, 2.0)]
    t = stats.quantile_table(df, ["v", "column_name"], [0.5], by=["a.b"]).toDF("g", "c", "q").collect()
    assert sorted(map(tuple, t)) == [("x", "column_name", 3.0), ("x", "v", 2.0), ("y", "column_name", 6.0)]
    assert {r.column_name: r.n_missing for r in stats.null_counts(df).collect()} == {"a.b": 0, "v": 1, "column_name": 0}
    assert {tuple(r)[1:4] for r in stats.moments(df, ["v"], by=["a.b"]).collect()} == {("v", 2, 2.0)}
