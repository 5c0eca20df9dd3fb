from pyspark.sql import functions as F

from tablewright.operators import profile as P


def test_top_values_and_distinct_frequencies(spark):
    df = spark.createDataFrame([(k,) for k in "aabbc"], "k string")
    top = [(r.rank, r.value, r.n) for r in P.top_values(df, k=5).orderBy("rank").collect()]
    assert top == [(1, "a", 2), (2, "b", 2), (3, "c", 1)]
    cs = P.categorical_summary(df).collect()[0]
    assert cs.unique_values == 3 and cs.distinct_frequencies == 2


def test_empty_table_percentages_null(spark):
    df = spark.createDataFrame([], "x double")
    r = P.missing_table(df).collect()[0]
    assert r.n_missing == 0 and r.missing_pct is None


def test_bool_counts_as_categorical(spark):
    df = spark.createDataFrame([(True, 1), (False, 2), (True, 3)], "flag boolean, n int")
    prof = P.profile(df)
    assert [r.column_name for r in prof.categorical.collect()] == ["flag"]
    assert [r.column_name for r in prof.numeric.collect()] == ["n"]


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "x int, s string")
    assert P.duplicate_rows(df).collect()[0].duplicate_rows == 1


def test_numeric_summary_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    r = P.numeric_summary(df).collect()[0]
    assert (r["count"], r.mean, r.min, r.q25, r.q50, r.q75, r.max) == (5, 22.0, 1.0, 2.0, 3.0, 4.0, 100.0)
    assert r.std == 43.62  # sqrt(7610 / 4)


def test_profile_json_is_one_document(spark):
    import json
    df = spark.createDataFrame([(1, "a"), (None, "b")], "x int, s string")
    doc = json.loads(P.profile(df).to_json().collect()[0][0])
    assert doc["overview"]["n_rows"] == 2 and doc["duplicates"]["duplicate_rows"] == 0
    assert {m["column_name"] for m in doc["missing"]} == {"x", "s"}


def test_categorical_summary_approx(spark):
    df = spark.createDataFrame([(str(i % 50),) for i in range(1000)], "k string")
    r = P.categorical_summary(df, approx=True).collect()[0]
    assert abs(r.unique_values - 50) <= 3


def test_profile_collect_records_failing_part(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string")
    prof = P.profile(df)
    got = prof.collect()
    assert got["overview"][0]["n_rows"] == 2 and "error" not in got["top_values"]
    # a part that cannot be computed is recorded, the others are still returned
    prof.top_values = df.selectExpr("assert_true(x > 5) as boom")
    got = prof.collect()
    assert "error" in got["top_values"] and got["missing"]


def test_failing_column_is_a_row_with_its_message(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, "b", "y", 2.0), (3, "b", None, 3.0)], "n int, good string, bad string, v double")
    df = df.withColumn("bad", F.when(F.col("bad") == "y", F.raise_error("no value").cast("string")).otherwise(F.col("bad")))
    got = P.profile(df).collect()
    assert "no value" in got["overview"][0]["error"] and "no value" in got["duplicates"]["error"]
    gaps = {r["column_name"]: r for r in got["missing"]}
    assert gaps["v"]["n_missing"] == 0 and "no value" in gaps["bad"]["error"] and len(gaps) == 4
    summary = {r["column_name"]: r for r in got["categorical_summary"]}
    assert summary["good"]["unique_values"] == 2 and "no value" in summary["bad"]["error"]
    assert {r["column_name"] for r in got["numeric_summary"]} == {"n", "v"}
    top = got["top_values"]
    assert [(r["value"], r["n"]) for r in top if r["column_name"] == "good"] == [("b", 2), ("a", 1)]
    assert ["no value" in r["error"] for r in top if r["column_name"] == "bad"] == [True]


def test_profile_counts_values_once(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(v):
        seen.add(1)
        return v

    prof = P.profile(df.withColumn("k", noted.asNondeterministic()("k")))
    before = seen.value
    prof.categorical.collect(), prof.top_values.collect()
    assert seen.value - before == 3
