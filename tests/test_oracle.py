"""Every registered query with SQL against DuckDB on the smallest data."""

import compare
import pytest

import __spark_entry__ as contract
from supplyspark import catalog

FOLDER = "/root/testdata/sf0.001"
# The corpus operators have their own tests.
QUERIES = {name: run for name, run in contract.queries().items() if name in catalog.QUERIES}
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_matches_sql(spark, oracle, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), oracle, ORACLE[name]) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_queries_without_sql_are_the_learned_models():
    assert set(catalog.QUERIES) - set(ORACLE) == {
        *("ridge_forecast", "gbt_forecast", "gbt_forecast_7", "gbt_forecast_14", "gbt_forecast_28"),
        *("inventory_classifiers", "supplier_classifiers"),
    }
