"""Every registered query against its DuckDB oracle on the small fixture
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from ledgerline.plans.oracles import ORACLES
from ledgerline.plans.registry import QUERIES
from ledgerline.plans.verify import compare, duck_connection

from fixture_paths import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["month_start", "month", "revenue", "expenses"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLES[name]).df()
    ok, why = compare(got, want)
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
