"""Registered queries: marts and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import MART_TABLES, Marts, State
from tidemark.plans import audit, marts
from tidemark.registry.core_sql import dates_as_text, over_core
from tidemark.registry.portable import portable
from tidemark.session import configure, written
from tidemark.sources.tables import core_from_tables

_MANAGEMENT_INPUTS = ("sales_monthly", "inventory_health_monthly",
                      "procurement_supplier_monthly", "expedition_monthly",
                      "vehicle_utilization_monthly")


_AMOUNTS = ("revenue", "estimated_cost", "gross_profit")


def _core_query(build):
    def run(spark, directory):
        return portable(build(core_from_tables(configure(spark), directory)))
    return run


def _mart_sql(name: str) -> str:
    return over_core(dates_as_text("*", name, "month_start"))


def _beyond(core):
    """Amounts of the sales mart times 10^8: some are within the declared type, some beyond."""
    factor = F.lit("100000000").cast("decimal(9,0)")
    amounts = marts.sales_monthly(core).select(
        "month_start", *[(F.col(c) * factor).alias(c) for c in _AMOUNTS])
    return audit.overflow_violations(amounts, "sales_monthly", ["month_start"]).withColumn(
        "value", F.col("value").cast("double"))


def _fleet(core):
    return marts.fleet_by_month(marts.vehicle_utilization_monthly(core))


def stored_state(core) -> State:
    """The reduced tables, each written on first use."""
    plain = marts.reduced(core)
    return State(**{name: (lambda n=name: written(getattr(plain, n), n)) for name in State.names})


def stored_inventory(core, state: State) -> DataFrame:
    """The inventory mart from stored lines: stock is dealt out once, by product.

    The snapshots are written first, as Spark then knows their size, and does not deal the stock out by snapshot where they are few.
    """
    core = core.replace(inventory_snapshots=written(core.inventory_snapshots, "snapshots"))
    return marts.inventory_health_monthly(
        core, state, detail=written(marts.inventory_detail(core, state).drop("product_id"), "inventory_lines"))


def stored_marts(core) -> Marts:
    """Marts written on first use, as readers find them after a refresh: the driver plans and runs one step at a time."""
    state, found = stored_state(core), {}

    def costed():
        if "costed" not in found:
            found["costed"] = written(marts.costed_product_days(core, state), "costed_days")
        return found["costed"]

    def mart(name: str):
        if name not in found:
            if name == "management_kpis_monthly":
                plan = marts.management_kpis_monthly(*[mart(n) for n in _MANAGEMENT_INPUTS])
            elif name in ("sales_monthly", "product_sales_monthly"):
                plan = getattr(marts, name)(core, state, costed())
            elif name == "inventory_health_monthly":
                plan = stored_inventory(core, state)
            else:
                plan = getattr(marts, name)(core, state)
            found[name] = written(plan, name)
        return found[name]

    return Marts(**{name: (lambda n=name: mart(n)) for name in MART_TABLES})


def _months(core):
    """The marts' months, one mart after the other."""
    state = stored_state(core)
    return marts.mart_months(*[written(getattr(marts, name)(core, state).select("month_start"), name)
                               for name in _MANAGEMENT_INPUTS[:4]])


QUERIES = {
    "m00_as_of_unit_cost": _core_query(marts.as_of_unit_cost),
    "m01_sales_monthly": _core_query(marts.sales_monthly),
    "m02_product_sales_monthly": _core_query(marts.product_sales_monthly),
    "m03_inventory_health_monthly": _core_query(marts.inventory_health_monthly),
    "m03a_monthly_units": _core_query(marts.monthly_units),
    "m03b_days_of_cover": _core_query(lambda core: marts.inventory_detail(core).select(
        "month_start", "product_id", "units_sold",
        F.round("days_of_cover", 6).alias("days_of_cover"))),
    "m04_procurement_supplier_monthly": _core_query(marts.procurement_supplier_monthly),
    "m05_expedition_monthly": _core_query(marts.expedition_monthly),
    "m06_vehicle_utilization_monthly": _core_query(marts.vehicle_utilization_monthly),
    "m07_management_kpis_monthly": _core_query(
        lambda core: stored_marts(core).management_kpis_monthly),
    "m07a_mart_months": _core_query(_months),
    "m07b_month_spine": _core_query(lambda core: marts.month_spine(_months(core))),
    "m07c_procurement_by_month": _core_query(lambda core: marts.procurement_by_month(
        marts.procurement_supplier_monthly(core))),
    "m07d_fleet_by_month": _core_query(_fleet),
    "constraint_overflow": _core_query(_beyond),
}

ORACLE = {
    "m00_as_of_unit_cost": over_core("""
        select distinct product_id, cast(order_date as varchar) as order_date,
               unit_cost / 100.0::double as unit_cost, known as has_historical_cost
        from priced"""),
    "m01_sales_monthly": _mart_sql("sales_monthly"),
    "m02_product_sales_monthly": _mart_sql("product_sales_monthly"),
    "m03_inventory_health_monthly": _mart_sql("inventory_health_monthly"),
    "m03a_monthly_units": _mart_sql("monthly_units"),
    "m03b_days_of_cover": over_core("""
        select cast(month_start as varchar) as month_start, product_id, units_sold,
               cast(round(cast(cover as decimal(38,10)), 6) as double) as days_of_cover
        from stock_lines"""),
    "m04_procurement_supplier_monthly": _mart_sql("procurement_supplier_monthly"),
    "m05_expedition_monthly": _mart_sql("expedition_monthly"),
    "m06_vehicle_utilization_monthly": over_core(
        "select * replace (cast(month_start as varchar) as month_start, "
        "cast(vehicle_id as bigint) as vehicle_id, cast(capacity_kg as bigint) as capacity_kg)"
        " from vehicle_utilization_monthly"),
    "m07_management_kpis_monthly": _mart_sql("management_kpis_monthly"),
    "m07a_mart_months": _mart_sql("all_months"),
    "m07b_month_spine": _mart_sql("spine"),
    "m07c_procurement_by_month": _mart_sql("procurement_by_month"),
    "m07d_fleet_by_month": _mart_sql("fleet_by_month"),
    "constraint_overflow": over_core(" union all ".join(f"""
        select 'sales_monthly' as table_name, cast(month_start as varchar) as key, '{c}' as column_name,
               cast(amount as double) as value, 'decimal(16,2)' as declared
        from (select month_start, cast(round({c} * 100) as hugeint) * 1000000 as amount from sales_monthly)
        where abs(amount) > 99999999999999""" for c in _AMOUNTS)),
}
