from __future__ import annotations

import pytest

from folioscope.plans.oracles import oracle_sql
from folioscope.plans.queries import QUERIES

from .compare import DATA, engine, rows


@pytest.fixture(scope="module")
def other():
    return engine()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_both_engines_agree(spark, other, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), other.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["qid", "pid", "source", "lang", "alternates", "place"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
