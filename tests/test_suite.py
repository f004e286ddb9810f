"""Every registered query against its oracle, on the smallest tables."""

import pytest
from conftest import SF

from __spark_entry__ import entry, oracle_sql
from check_oracle import compare, connect
from starmill.suite import ORACLES, QUERIES

# Each of these stores a whole star first; one of them is enough here (check_oracle.py runs all).
SLOW = {"gold_row_counts", "build_product", "list_products", "product_customer_360",
        "product_profitability", "product_margin_by_month", "product_cancellation_risk",
        "product_supplier_scorecard", "profile_sources", "load_layers", "dim_scd2_customer"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
