"""The driver contract, and every SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare

ORACLES = contract.oracle_sql()
QUERIES = contract.queries()


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["name", "race_name", "gender_name", "age_group", "cnt", "base_count", "percentage"]
    assert rows.count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    verdict, _ = compare(spark, sf, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
