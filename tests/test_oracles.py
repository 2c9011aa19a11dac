import pytest
from oracle import assert_same, connect

from pathloom.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert_same(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["model_logreg", "model_predict", "weibull_mcmc", "posterior_predictive", "log_fingerprint", "simulate_transition"])
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
