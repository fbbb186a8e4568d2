"""Every registered query with a SQL twin equals DuckDB on the same tables
(sf0.001; the driver checks sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from huddle.plans import catalog
from tools.check_oracle import canon, duck

SF = os.environ.get("HUDDLE_TEST_SF", "/root/testdata/sf0.001")
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    d_cols = [d[0] for d in res.description]
    d_types = {d[0]: str(d[1]) for d in res.description}
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields} == d_types
    assert len(s_rows) == len(d_rows)
    assert canon(s_rows, df.columns) == canon(d_rows, d_cols)


def test_every_query_has_twin_or_is_a_model():
    models = {"assemble_features", "segment_model_role_count", "segment_model_team", "segment_model_formation",
              "grid_search_forest", "grid_search_boosted", "grid_search_logistic", "random_search",
              "top_importances", "entity_model", "ols_summary", "segment_confusion", "segment_importances",
              "grid_search_xgboost", "tuned_forest"}
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == models


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "LT_y" in df.columns
