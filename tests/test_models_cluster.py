import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cluster as CU
from tablewright.operators import features as FE
from tablewright.operators import metrics as M
from tablewright.operators import models as ML


def test_binary_metrics_zero_division_and_full_grid(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 0)], "y int, p int")
    cm = M.confusion_matrix(df, "y", "p").collect()
    assert len(cm) == 9 and sum(r.n for r in cm) == 4
    m = M.classification_metrics(df, "y", "p", "weighted").collect()[0]
    assert m.accuracy == 0.5 and m.recall == 0.5 and m.precision == pytest.approx(0.25)
    b = M.classification_metrics(spark.createDataFrame([(0, 0), (1, 0)], "y int, p int"), "y", "p", "binary").collect()[0]
    assert b.precision == 0.0 and b.recall == 0.0 and b.f1 == 0.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    m = M.regression_metrics(df).collect()[0]
    assert m.mse == pytest.approx(1 / 6) and m.rmse == pytest.approx(math.sqrt(1 / 6))
    assert m.mae == pytest.approx(1 / 3) and m.r2 == pytest.approx(1 - (1 / 6) / (2 / 3))


def test_task_detection_threshold(spark):
    df16 = spark.createDataFrame([(float(i),) for i in range(16)], "y double")
    df15 = spark.createDataFrame([(float(i),) for i in range(15)], "y double")
    assert FE.detect_task(df16, "y")[0] == "regression"
    assert FE.detect_task(df15, "y")[:2] == ("classification", "multiclass")
    with pytest.raises(ValueError):
        FE.detect_task(spark.createDataFrame([(1.0,)], "y double"), "y")
    with pytest.raises(ValueError):
        FE.detect_task(df15, "y", "cluster")


def test_feature_selection_errors(spark):
    df = spark.createDataFrame([(1, 2, "a")], "a int, b int, t string")
    assert FE.select_features(df, "t", "a, b") == ["a", "b"]
    with pytest.raises(ValueError):
        FE.select_features(df, "t", ["zz"])
    with pytest.raises(ValueError):
        FE.select_features(df, "t", ["a", "t"])


def test_one_hot_drops_first_level_and_null_is_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    out = FE.one_hot(df, ["k"])
    assert out.columns == ["k_b", "k_c"]
    assert [tuple(r) for r in out.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_label_codes_sorted(spark):
    df = spark.createDataFrame([("z",), ("a",), ("m",), ("a",)], "t string")
    codes = {r.label: r.code for r in FE.label_codes(df, "t").collect()}
    assert codes == {"a": 0, "m": 1, "z": 2}


def test_stratified_split_ceil_per_class(spark):
    rows = [(i, "x" if i % 3 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "k int, lbl string")
    s = FE.stratified_split(df, "lbl", "k", 0.2)
    got = {r.lbl: r.n for r in s.where("is_test").groupBy("lbl").agg(F.count("*").alias("n")).collect()}
    assert got == {"x": math.ceil(0.2 * 66), "y": math.ceil(0.2 * 34)}
    again = FE.stratified_split(df.repartition(5), "lbl", "k", 0.2)
    assert sorted(r.k for r in s.where("is_test").collect()) == sorted(r.k for r in again.where("is_test").collect())


def test_train_model_regression_and_classification(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(3 * x + rng.normal(0, 0.1)), "p" if x > 0 else "n") for i, x in enumerate(rng.normal(0, 1, 400))]
    df = spark.createDataFrame(rows, "id int, x double, y double, c string")
    r = ML.train_model(df, "y", key="id", features=["x"], num_trees=5)
    assert r.task == "regression" and r.best_model == "Linear Regression"
    r2 = {x.model: x.value for x in r.metrics.where("metric = 'r2'").collect()}
    assert r2["Linear Regression"] > 0.99
    c = ML.train_model(df, "c", key="id", features=["x"], num_trees=5)
    assert c.task == "classification" and c.classification_type == "binary"
    acc = [x.value for x in c.metrics.where("metric = 'accuracy'").collect()]
    assert all(a > 0.9 for a in acc)
    assert c.confusion.groupBy("model").agg(F.sum("n").alias("n")).collect()[0].n == c.predictions["Logistic Regression"].count()


def test_null_target_rejected(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 1.0)], "id int, x double, y double")
    with pytest.raises(ValueError):
        ML.train_model(df, "y", key="id")


def test_kmeans_two_blobs(spark):
    rng = np.random.default_rng(4)
    a = rng.normal([0, 0], 0.2, (60, 2))
    b = rng.normal([5, 5], 0.2, (40, 2))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([a, b]))]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    r = CU.kmeans(df, "id", k=2, n_init=2)
    sizes = sorted(x["size"] for x in r.sizes().collect())
    assert sizes == [40, 60]
    labels = {x.id: x.cluster for x in r.assignments.collect()}
    assert len({labels[i] for i in range(60)}) == 1 and len({labels[i] for i in range(60, 100)}) == 1
    assert r.inertia == pytest.approx(r.assignments.agg(F.sum("dist2")).collect()[0][0], rel=1e-6)


def test_kmeans_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, x double")
    with pytest.raises(ValueError):
        CU.kmeans(df, "id", k=1)
    with pytest.raises(ValueError):
        CU.kmeans(df, "id", k=2)
    with pytest.raises(ValueError):
        CU.cluster_features(spark.createDataFrame([("a",)], "s string"), ["s"])


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (2.0,)], "x double")
    out, _ = FE.standard_scale(df, ["x"])
    assert [r.x for r in out.collect()] == [0.0, 0.0, 0.0]


def test_impute_on_train_uses_train_medians(spark):
    rows = [(i, None if i % 10 == 0 else float(i), float(2 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    data, names, task, *_ = ML.prepare(df, "y", "id", impute_on="train")
    assert task == "regression" and names == ["x"]
    with pytest.raises(ValueError):
        ML.prepare(df, "y", "id", impute_on="test")


def test_one_hot_vector_matches_explicit_columns(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, k string")
    vec = {r.id: r.k_vec.toArray().tolist() for r in FE.one_hot_vector(df, "k").collect()}
    assert vec[2] == [0.0, 0.0] and vec[3] == [0.0, 0.0]        # first level and missing: zeros
    assert sorted(map(tuple, [vec[1], vec[4]])) == [(0.0, 1.0), (1.0, 0.0)]


def test_one_hot_vectors_levels_missing_and_odd_names(spark):
    rows = [(1, "b", "x"), (2, "a", "x"), (3, None, None), (4, "c", "x")]
    df = spark.createDataFrame(rows, ["id", "k.1", "only"])
    out, codes, slots = FE.one_hot_vectors(df, ["k.1", "only"], ["k.1", "only"])
    got = {r["id"]: (r["k.1"].toArray().tolist(), r["only"].toArray().tolist()) for r in out.collect()}
    # slot n - 1 - code; one level has one slot that is never set
    assert got == {1: ([0.0, 1.0], [0.0]), 2: ([0.0, 0.0], [0.0]), 3: ([0.0, 0.0], [0.0]), 4: ([1.0, 0.0], [0.0])}
    assert slots == {"k.1": 2, "only": 1} and codes.count() == 4


def test_importances_by_level(spark):
    rows = [(i, "abcd"[i % 4], i % 7, 10.0 * (i % 4 == 2) + i % 7 + i / 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, n int, y double")
    r = ML.train_model(df, "y", key="id", num_trees=5, only="Random Forest Regressor")
    imp = {x.feature: x.importance for x in r.importances.collect()}
    assert set(imp) == {"k_b", "k_c", "k_d", "n"} and max(imp, key=imp.get) == "k_c"
    assert sum(imp.values()) == pytest.approx(1)


def test_non_numeric_feature_is_rejected(spark):
    df = spark.createDataFrame([(i, [i], float(i)) for i in range(40)], "id int, a array<int>, y double")
    with pytest.raises(ValueError, match="non-numeric"):
        ML.train_model(df, "y", key="id")


def test_task_of_a_sorted_target_with_late_values(spark):
    few = spark.range(0, 30_000, 1, 1).select((F.col("id") / 25_000).cast("int").alias("y"))
    assert FE.detect_task(few, "y") == ("classification", "binary", 2)
    late = spark.range(0, 30_000, 1, 1).select(F.greatest(F.lit(0), F.col("id") - 29_000).alias("y"))
    assert FE.detect_task(late, "y") == ("regression", None, 16)
    assert FE.detect_task(spark.range(100).select(F.when(F.col("id") > 50, 1).when(F.col("id") > 20, 0).alias("a.b")), "a.b")[1] == "binary"


def test_stratified_split_repeated_keys_and_missing_labels(spark):
    rows = [(i % 50, None if i % 5 == 0 else "x") for i in range(200)]
    s = FE.stratified_split(spark.createDataFrame(rows, "k int, `l.b` string"), "l.b", "k", 0.2).collect()
    sides = {}
    for r in s:
        sides.setdefault((r["k"], r["l.b"]), set()).add(r["is_test"])
    assert len(s) == 200 and all(len(v) == 1 for v in sides.values())    # rows with one key stay together
    for label, n in ((None, 40), ("x", 160)):
        test = sum(r["is_test"] for r in s if r["l.b"] == label)
        assert math.ceil(0.2 * n) <= test < math.ceil(0.2 * n) + 4


def test_large_training_tables_are_dealt_out(spark, monkeypatch):
    """However few partitions the table has, none of the training table holds more points than the bound."""
    df = spark.range(4000, numPartitions=1).selectExpr("id as k", "id % 7 as a", "cast(id % 3 as string) as t", "cast(id % 2 as string) as y")
    plain = {r["k"]: tuple(r)[1:] for r in ML.prepare(df, "y", "k")[0].collect()}
    monkeypatch.setattr(ML, "PARTITION_BYTES", 100_000)
    data = ML.prepare(df, "y", "k")[0]
    sizes = [r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == ML._partitions_needed(4000, 3, 100) > 10 and max(sizes) < 4000 / 10
    assert {r["k"]: tuple(r)[1:] for r in data.collect()} == plain


def test_kmeans_deals_large_tables_out(spark, monkeypatch):
    df = spark.range(3000, numPartitions=1).selectExpr("id as k", "(id % 3) * 100 + id % 5 as a", "(id % 3) * 50 + id % 11 as b")
    plain = CU.kmeans(df, "k", 3, n_init=2)
    monkeypatch.setattr(CU, "PARTITION_ROWS", 500)
    dealt = CU.kmeans(df, "k", 3, n_init=2)
    assert dealt.assignments.rdd.getNumPartitions() == 6 and abs(dealt.inertia - plain.inertia) < 1e-6
    assert sorted(r["size"] for r in dealt.sizes().collect()) == [1000] * 3
