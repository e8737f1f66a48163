"""Every registered query with SQL against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E
from cohortry import catalog
from check import TABLES, compare
from test_plans import check_plan

FOLDER = "/root/testdata/sf0.001"
# fitted models run in their own tests and in tools/check.py
SLOW = {"nested_cv", "random_search", "gbt_multiclass", "gbt_regression", "gbt_importance", "gbt_early_stopping", "gbt_quality", "smote_tomek"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_sql_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_has_a_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["member_id", "dppr", "compliant"]
    assert df.count() >= 0


# the corpus operators have their own tests
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, con, name):
    df = E.queries()[name](spark, FOLDER)
    check_plan(df)
    status, _, _, note = compare(spark, con, name, lambda *_: df, E.oracle_sql().get(name), FOLDER)
    assert status in ("ok", "rows-only"), note
