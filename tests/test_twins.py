"""Every query with a twin gives the same columns, types and values as DuckDB."""

import pytest

import __spark_entry__ as entry_module
from conftest import DATA
from lastleg.oracle.twins import TWINS
from lastleg.plans.registry import QUERIES

DUCK_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def _key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_twin(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = duck.execute(TWINS[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    types = {c[0]: str(c[1]) for c in cursor.description}
    assert {f.name: DUCK_TYPES[f.dataType.simpleString()] for f in df.schema} == types
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    assert sorted(got, key=_key) == sorted(want, key=_key)


def test_every_twin_has_a_query():
    # fitted models and zones depend on the start and on rounding: tests check them
    fitted = {"ml_late", "ml_breach", "ml_delay", "ml_congestion", "model_results", "model_status", "model_top_features", "score_orders",
              "score_all_models", "delivery_clusters"}
    assert set(TWINS) == set(QUERIES) - fitted
    assert set(QUERIES) <= set(entry_module.queries()) and set(TWINS) <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "city" and df.count() == 6
