"""The pipeline: contract of the stages, and the SQL twins of the queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tablewright.llm import queries
from tests.conftest import SF_SMALL

TABLES = ("documents", "benchmark", "labels")


def test_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL) <= set(entry.oracle_sql())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF_SMALL)
        assert out.dtypes == docs.dtypes, name
        now = {r["doc_id"] for r in out.collect()}
        assert now <= ids and len(now) > 0.5 * len(ids), name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.run(spark, SF_SMALL)
    assert {r["doc_id"] for r in final.collect()} == {r["doc_id"] for r in kept.collect()}
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), SF_SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
