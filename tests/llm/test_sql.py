"""Queries of the subpackage that SQL can express, over whole tables."""
import pytest

from tools.check import compare, duck
from veilstream.llm.registry import registered

QUERIES, ORACLES = registered()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    ok, text = compare(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, text


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
