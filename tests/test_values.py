"""Values that must survive cleaning: fractional fills of integers, long ids, NaN keys, quoted fields."""

import hashlib

from pyspark.sql import functions as F

from tablewright.operators import chartdata, clean, metrics, stats
from tablewright.operators import features as FE
from tablewright.operators import models as ML
from tablewright.operators.profile import duplicate_rows
from tablewright.sources.csv import read_csv_text


def test_fractional_fill_widens_integers(spark):
    df = spark.createDataFrame([(1, 9007199254740993), (2, 9007199254740993), (None, None)], "a bigint, b bigint")
    out = clean.apply_fills(df, {"a": 1.5, "b": 9007199254740993})
    assert dict(out.dtypes) == {"a": "double", "b": "bigint"}
    assert [tuple(r) for r in out.collect()][-1] == (1.5, 9007199254740993)
    assert stats.modes(df, ["b"]).first()["mode"] == "9007199254740993"


def test_long_ids_stay_distinct(spark):
    df = spark.createDataFrame([("12345678901234567",), (" 12345678901234569 ",), ("1e3",), ("x",)], "id string")
    got = [r["id"] for r in clean.apply_types(df, {"id": ("integer", None)}).collect()]
    assert got == [12345678901234567, 12345678901234569, 1000, None]


def test_nan_keys_and_empty_sums(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (1.0, None), (2.0, 3.0)], "k double, v double")
    got = {r["k"]: r["v"] for r in chartdata.bar(df, "k", "v", "sum").collect()}
    assert got == {1.0: 0.0, 2.0: 3.0}


def test_r2_of_constant_target(spark):
    for p, want in ((3.0, 1.0), (4.0, 0.0)):
        df = spark.createDataFrame([(3.0, p), (3.0, 3.0)], "y double, p double")
        assert metrics.regression_metrics(df).first()["r2"] == want


def test_quoted_csv_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x ""q"", y"\n2,"two\nlines"\n3,<NA>\n')
    got = read_csv_text(spark, str(tmp_path / "a.csv"), multi_line=True).orderBy(F.col("id")).collect()
    assert [r["t"] for r in got] == ['x "q", y', "two\nlines", None]


def test_missing_values_are_duplicates(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 1.0)], "a int, x double")
    assert duplicate_rows(df).first()[0] == 1
    assert sorted(map(tuple, clean.drop_duplicates(df).collect())) == [(1, None), (2, 1.0)]


def test_stratified_split_keeps_values(spark):
    rows = [(i, i % 3, 9007199254740993 if i % 2 else None) for i in range(300)]
    out = FE.stratified_split(spark.createDataFrame(rows, "k int, y int, big bigint"), "y", "k", 0.2)
    got = out.collect()
    assert sorted((r["k"], r["y"], r["big"]) for r in got) == rows
    assert sum(r["is_test"] for r in got) == 60
    order = sorted((k for k, y, _ in rows if y == 1), key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))
    assert {r["k"] for r in got if r["is_test"] and r["y"] == 1} == set(order[:20])
    assert not any(r["is_test"] for r in FE.stratified_split(spark.createDataFrame(rows, "k int, y int, big bigint"), "y", "k", 0.0).collect())


def test_nan_and_null_groups_apart(spark):
    rows = [(float("nan"), float(i)) for i in range(5)] + [(None, float(i)) for i in range(100, 105)]
    df = spark.createDataFrame(rows, "g double, x double")
    for most in (1, 1_000_000):
        got = stats.quantiles(df, ["x"], [0.5], by=["g"], most=most).collect()
        assert sorted((str(r["g"]), r["value"]) for r in got) == [("None", 102.0), ("nan", 2.0)]


def test_many_labels_and_levels(spark):
    pred = spark.range(1001).select(F.col("id").cast("double").alias("y"), F.lit(0.0).alias("p"))
    assert metrics.confusion_matrix(pred).count() == 1001 ** 2
    rows = spark.range(2400).select("id", (F.col("id") % 1200).cast("string").alias("name"),
                                    (F.col("id") * 0.5).alias("x"), (F.col("id") % 97 + F.col("id") * 0.1).alias("y"))
    r = ML.train_model(rows, "y", "id", only="Random Forest Regressor", num_trees=2, max_depth=3)
    # one importance per level whatever the number of levels; "0" is the first one and dropped
    assert {f["feature"] for f in r.importances.collect()} == {"x"} | {f"name_{i}" for i in range(1, 1200)}
