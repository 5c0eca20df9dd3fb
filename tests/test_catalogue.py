"""Catalogue contract and a DuckDB comparison on sf0.001 for a sample of queries."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import rows_of  # noqa: E402
from tablewright.plans.fixtures import TABLES  # noqa: E402
from tablewright.plans.registry import load_all  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

SAMPLE = ["c22_clean_default", "c20_remove_outliers_iqr", "b08_numeric_summary", "b11_top_values",
          "d08_box_by_group", "d11_pie_topk_other", "d14_violin_density", "e10_stratified_split",
          "e17_weighted_metrics", "f10_cluster_summary", "a01_csv_source", "g03_grouped_pandas"]


def test_catalogue_ids_and_names():
    q = load_all()
    assert len(q) > 100
    for name, item in q.items():
        assert item.ids, name
        assert not name.startswith("op")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, con, name):
    q = load_all()[name]
    sdf = q.fn(spark, SF_SMALL)
    res = con.execute(q.sql)
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(dcols, res.fetchall())
