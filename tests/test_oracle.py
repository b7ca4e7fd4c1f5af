"""Every registered query on the smallest tables, beside its SQL where there is one."""

import pytest

from compare import connect, difference
from driver_queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
MAY_BE_NULL = set()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER).toPandas()
    assert len(df)
    for column in df.columns:
        if df[column].dtype.kind == "f" and column in ("p_value", "adj_p_value"):
            known = df[column].dropna()
            assert len(known) and known.between(0, 1).all()
        elif column not in MAY_BE_NULL:
            assert df[column].notna().any()


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
