"""Every registered query against its SQL."""

import pytest

from tools.check import compare, duck
from workload import registered

QUERIES, ORACLES = registered()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    ok, text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, text


def test_most_queries_have_sql():
    assert set(ORACLES) <= set(QUERIES)
    without = set(QUERIES) - set(ORACLES)
    # random draws; *_properties and *_totals hold them against what must be true of them
    assert without == {"noisy_speed", "dummy_locations", "updated_place_counts"}


def test_entry_runs(spark):
    import __spark_entry__ as contract
    df = contract.entry(spark)
    assert df.columns == ["app", "vehicle_id", "event_id", "generate_ms", "pet_label", "processed"]
    assert df.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
