import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import transform as TR
from tablewright.sources import csv as CSV
from tablewright.sources.dataset import Dataset, change_status, compare, head, tail


def test_csv_null_tokens_and_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d,e\n1,1.5,true,NA,x\n2,,False,null,\nN/A,3e2,TRUE,,y\n")
    df = CSV.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}
    rows = df.collect()
    assert [r.a for r in rows] == [1, 2, None] and [r.b for r in rows] == [1.5, None, 300.0]
    assert [r.c for r in rows] == [True, False, True] and all(r.d is None for r in rows)


def test_head_tail(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in head(df, 3, "k").collect()] == [0, 1, 2]
    assert [r.k for r in tail(df, 3, "k").collect()] == [7, 8, 9]


def test_dataset_views(spark):
    a = spark.createDataFrame([(1,), (1,)], "x int")
    ds = Dataset(a)
    assert ds.active is a and ds.show_view("cleaned").active is a
    b = a.dropDuplicates()
    ds2 = ds.with_cleaned(b)
    assert ds2.active is b and ds2.active_view == "cleaned" and ds.cleaned is None
    assert ds2.profile().overview.collect()[0].n_rows == 1


def test_compare_and_status(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    diff = {r.side: r.n_rows for r in compare(a, a.dropDuplicates()).collect()}
    assert diff == {"removed": 1, "added": 0}
    assert change_status(a, a) == "unchanged" and change_status(None, a) == "created"


def test_grouped_pandas_matches_pandas(spark):
    pdf = pd.DataFrame({"g": ["h"] * 50 + ["c"] * 5, "v": [float(i) for i in range(55)], "id": range(55)})
    df = spark.createDataFrame(pdf)

    def partial(p):
        return pd.DataFrame({"g": [p.g.iloc[0]], "s": [p.v.sum()], "n": [len(p)]})

    def combine(p):
        return pd.DataFrame({"g": [p.g.iloc[0]], "mean": [p.s.sum() / p.n.sum()]})

    def merge(p):
        return pd.DataFrame({"g": [p.g.iloc[0]], "s": [p.s.sum()], "n": [p.n.sum()]})

    for options in ({}, {"merge": merge}, {"merge": merge, "held": 1}):
        out = TR.grouped_pandas(df.repartition(3), ["g"], partial, combine, "g string, s double, n long", "g string, mean double", **options)
        got = {r.g: r.mean for r in out.collect()}
        assert got == pytest.approx(pdf.groupby("g").v.mean().to_dict())
    nulls = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("c", 5.0, 3)], "g string, v double, id int")
    out = TR.grouped_pandas(nulls, ["g"], partial, combine, "g string, s double, n long", "g string, mean double", merge=merge)
    assert {r.g: r.mean for r in out.collect()} == {None: 2.0, "c": 5.0}


def test_compare_counts_copies_nulls_and_nan(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, None, 1.0), (None, 1, 1.0), (2, 2, nan), (2, 2, nan), (3, 3, -0.0)], "`a.b` int, v int, x double")
    b = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (2, 2, nan), (3, 3, 0.0)], "`a.b` int, v int, x double")
    got = {r.side: r.n_rows for r in compare(a, b).collect()}
    assert got == {"removed": a.exceptAll(b).count(), "added": b.exceptAll(a).count()} == {"removed": 2, "added": 1}


def test_csv_records_names_and_long_integers(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('a.b,n,huge,t\n1,9223372036854775807,123456789012345678901,"one\ntwo, ""three"""\n2,-5,7,"4"\n')
    df = CSV.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"a.b": "bigint", "n": "bigint", "huge": "decimal(38,0)", "t": "string"}
    rows = df.toDF("a", "n", "huge", "t").collect()
    assert [tuple(r) for r in rows] == [(1, 2**63 - 1, 123456789012345678901, 'one\ntwo, "three"'), (2, -5, 7, "4")]
    q = tmp_path / "plain.csv"
    q.write_text('a,b\n1,"x"\n2,"y ""z"""\n')
    assert not CSV.breaks_in_quotes(spark, str(q)) and [r.b for r in CSV.read_csv(spark, str(q)).collect()] == ["x", 'y "z"']


def test_map_batches_and_sql(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    out = TR.map_batches(df, lambda p: p.assign(v=p.v * 10), "k int, v double")
    assert sorted(r.v for r in out.collect()) == [20.0, 30.0]
    assert TR.sql(spark, "select sum(v) s from {d}", d=df).collect()[0].s == 5.0
    res, status, _ = TR.run_user_code(df, lambda d: d.where(F.col("k") > 1))
    assert status == "changed" and res.count() == 1


def test_csv_user_schema(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("a,b\n 1 ,x\n2,y\n")
    df = CSV.read_csv(spark, str(p), schema="a int, b string")
    assert dict(df.dtypes) == {"a": "int", "b": "string"} and [r.a for r in df.collect()] == [1, 2]


def test_dataset_register_views(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    ds = Dataset(a, name="tw_reg").with_cleaned(a.dropDuplicates())
    ds.register()
    assert spark.sql("select count(*) c from tw_reg").collect()[0].c == 2
    assert spark.sql("select count(*) c from tw_reg_original").collect()[0].c == 3
