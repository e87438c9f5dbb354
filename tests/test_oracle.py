"""Registered queries against SQL in DuckDB.  A sample by default, all with TIDEMARK_ALL=1."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from tidemark import registry

DIRECTORY = "/root/testdata/sf0.001"
SAMPLE = (
    "m01_sales_monthly", "m02_product_sales_monthly", "m03_inventory_health_monthly",
    "m04_procurement_supplier_monthly", "m05_expedition_monthly",
    "m06_vehicle_utilization_monthly", "m07_management_kpis_monthly", "rule_e010_sales",
    "rule_e050_sales", "rule_e080_expedition", "check_e005_duplicate_sales_row",
    "check_w012_incomplete_snapshot", "check_w018_w019_load_differences", "s05b_stage_sales",
    "s09_batch_state", "s10_layer_counts", "c05_text_surrounding_whitespace",
    "c09_decimal_scale_exceeded", "c14_value_rollup", "c15_value_totals",
    "p04_inventory_profile", "p09_validation_summary", "k01a_suppliers_next_batch",
    "k06_sales_order_lines", "r15_vehicle_months", "q02_summary", "q04_product_ranking",
    "q07_supplier_ranking",
)
NAMES = list(entry.queries()) if os.environ.get("TIDEMARK_ALL") else list(SAMPLE)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIRECTORY):
        pytest.skip("no driver tables here")
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    sql = entry.oracle_sql().get(name)
    run = entry.queries()[name]
    if sql is None:
        assert run(spark, DIRECTORY).count() >= 0
    else:
        assert compare(spark, duck, DIRECTORY, run, sql) is None


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_flagship(spark):
    if os.path.isdir(DIRECTORY):
        assert entry.entry(spark).count() == 80
