"""Checks of the marts against the core (run before publishing) and of published marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import month_of
from tidemark.model import OWN, Core, Marts


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(value.alias("v"))


def _check(name: str, expected: DataFrame, actual: DataFrame, null_safe: bool = False,
           code: str | None = None) -> DataFrame:
    """One row: expected and actual value (one-row inputs) and whether they agree.

    By default an unknown value fails, so refreshing an empty core is an error.  With
    ``null_safe`` two missing values agree.
    """
    left = expected.select(F.col("v").alias("expected"), actual.scalar().alias("actual"))
    same = F.col("expected").eqNullSafe(F.col("actual")) if null_safe else F.coalesce(
        F.col("expected") == F.col("actual"), F.lit(False))
    return left.select(
        F.lit(code).cast("string").alias("code"), F.lit(name).alias("check_name"),
        F.col("expected").cast("decimal(38,2)").alias("expected"),
        F.col("actual").cast("decimal(38,2)").alias("actual"), same.alias("valid"))


def _none(name: str, offending: DataFrame, code: str | None = None) -> DataFrame:
    """One row: no offending rows expected."""
    return offending.agg(F.count("*").alias("n")).select(
        F.lit(code).cast("string").alias("code"), F.lit(name).alias("check_name"),
        F.lit(0).cast("decimal(38,2)").alias("expected"),
        F.col("n").cast("decimal(38,2)").alias("actual"), (F.col("n") == 0).alias("valid"))


def _line_revenue(core: Core) -> DataFrame:
    return _one(core.sales_order_lines, F.round(F.sum(F.col("quantity") * F.col("unit_price")), 2))


def _sum(df: DataFrame, column: str) -> DataFrame:
    return _one(df, F.sum(column))


def _count(df: DataFrame) -> DataFrame:
    return _one(df, F.count("*"))


# --- before publishing: R01 - R08 ---------------------------------------------------------------

def sales_revenue(core: Core, marts: Marts) -> DataFrame:
    return _check("sales revenue", _line_revenue(core), _sum(marts.sales_monthly, "revenue"))


def product_sales_revenue(core: Core, marts: Marts) -> DataFrame:
    return _check("product sales revenue", _sum(marts.sales_monthly, "revenue"),
                  _sum(marts.product_sales_monthly, "revenue"))


def gross_profit_formula(core: Core, marts: Marts) -> DataFrame:
    wrong = F.col("gross_profit") != F.col("revenue") - F.col("estimated_cost")
    return _none("sales gross profit formula", marts.sales_monthly.where(wrong))


def inventory_month_count(core: Core, marts: Marts) -> DataFrame:
    return _check("inventory month count", _count(core.inventory_snapshots),
                  _count(marts.inventory_health_monthly))


def procurement_delivered_units(core: Core, marts: Marts) -> DataFrame:
    return _check("procurement delivered units",
                  _sum(core.purchase_order_lines, "delivered_quantity"),
                  _sum(marts.procurement_supplier_monthly, "delivered_units"))


def expedition_count(core: Core, marts: Marts) -> DataFrame:
    return _check("expedition count", _count(core.expeditions),
                  _sum(marts.expedition_monthly, "expedition_count"))


def vehicle_trip_count(core: Core, marts: Marts) -> DataFrame:
    return _check("vehicle trip count",
                  _count(core.expeditions.where(F.col("delivery_type") == OWN)),
                  _sum(marts.vehicle_utilization_monthly, "trip_count"))


def management_revenue(core: Core, marts: Marts) -> DataFrame:
    sales = marts.sales_monthly.select("month_start", F.col("revenue").alias("own"))
    both = marts.management_kpis_monthly.select("month_start", "revenue").join(
        sales, "month_start")
    return _none("management revenue reconciliation", both.where("revenue <> own"))


REFRESH_CHECKS = (
    sales_revenue, product_sales_revenue, gross_profit_formula, inventory_month_count,
    procurement_delivered_units, expedition_count, vehicle_trip_count, management_revenue,
)


def refresh_checks(core: Core, marts: Marts) -> DataFrame:
    """R01 - R08, one row each."""
    return reduce(DataFrame.unionByName, [check(core, marts) for check in REFRESH_CHECKS])


# --- published marts: R09 - R22 -------------------------------------------------------------------

def latest_run_status(runs: DataFrame) -> DataFrame:
    """The newest refresh exists (MART-E001) and is completed (MART-E002)."""
    last = runs.agg(F.max_by("status", "started_at").alias("status"))
    code = F.when(F.col("status").isNull(), "MART-E001").when(
        F.col("status") != "completed", "MART-E002")
    return last.select(code.alias("code"), F.lit("latest refresh").alias("check_name"),
                       F.col("status").alias("status"), code.isNull().alias("valid"))


def sales_months(core: Core, marts: Marts) -> DataFrame:
    months = core.sales_orders.select(month_of(F.col("order_date"))).distinct()
    return _check("sales_months", _count(months), _count(marts.sales_monthly), True, "MART-E010")


def product_sales_months(core: Core, marts: Marts) -> DataFrame:
    dates = core.sales_orders.select("order_id", month_of(F.col("order_date")).alias("m"))
    pairs = core.sales_order_lines.select("order_id", "product_id").join(dates, "order_id")
    return _check("product_sales_months", _count(pairs.select("m", "product_id").distinct()),
                  _count(marts.product_sales_monthly), True, "MART-E010")


def inventory_months(core: Core, marts: Marts) -> DataFrame:
    return _check("inventory_months", _count(core.inventory_snapshots),
                  _count(marts.inventory_health_monthly), True, "MART-E010")


def procurement_supplier_months(core: Core, marts: Marts) -> DataFrame:
    pairs = core.purchase_orders.select(month_of(F.col("order_date")), "supplier_id").distinct()
    return _check("procurement_supplier_months", _count(pairs),
                  _count(marts.procurement_supplier_monthly), True, "MART-E010")


def _shipping_months(core: Core) -> DataFrame:
    return core.expeditions.select(month_of(F.col("expedition_date"))).distinct()


def expedition_months(core: Core, marts: Marts) -> DataFrame:
    return _check("expedition_months", _count(_shipping_months(core)),
                  _count(marts.expedition_monthly), True, "MART-E010")


def vehicle_months(core: Core, marts: Marts) -> DataFrame:
    fleet = core.vehicles.agg(F.count("*")).scalar()
    cells = _one(_shipping_months(core), F.count("*")).select((F.col("v") * fleet).alias("v"))
    return _check("vehicle_months", cells, _count(marts.vehicle_utilization_monthly), True,
                  "MART-E010")


def published_sales_revenue(core: Core, marts: Marts) -> DataFrame:
    return _check("sales revenue", _line_revenue(core), _sum(marts.sales_monthly, "revenue"),
                  True, "MART-E020")


def published_product_revenue(core: Core, marts: Marts) -> DataFrame:
    return _check("product revenue", _line_revenue(core),
                  _sum(marts.product_sales_monthly, "revenue"), True, "MART-E021")


def published_gross_profit(core: Core, marts: Marts) -> DataFrame:
    """Core revenue - mart cost = mart profit; missing sums are not an error."""
    expected = _one(marts.sales_monthly, F.sum("estimated_cost")).select(
        (_line_revenue(core).scalar() - F.col("v")).alias("v"))
    row = _check("gross profit", expected, _sum(marts.sales_monthly, "gross_profit"), False,
                 "MART-E022")
    unknown = F.col("expected").isNull() | F.col("actual").isNull()
    return row.withColumn("valid", F.col("valid") | unknown)


def published_delivered_units(core: Core, marts: Marts) -> DataFrame:
    return _check("procurement delivered units",
                  _sum(core.purchase_order_lines, "delivered_quantity"),
                  _sum(marts.procurement_supplier_monthly, "delivered_units"), True,
                  "MART-E030")


def published_expeditions(core: Core, marts: Marts) -> DataFrame:
    return _check("expedition count", _count(core.expeditions),
                  _sum(marts.expedition_monthly, "expedition_count"), True, "MART-E040")


def published_trips(core: Core, marts: Marts) -> DataFrame:
    return _check("fleet trips", _count(core.expeditions.where(F.col("delivery_type") == OWN)),
                  _sum(marts.vehicle_utilization_monthly, "trip_count"), True, "MART-E041")


def percentages_in_range(core: Core, marts: Marts) -> DataFrame:
    """Rows of four marts whose percentages leave 0 - 100."""
    def outside(df: DataFrame, *columns: str) -> DataFrame:
        wrong = reduce(Column.__or__, [~F.col(c).between(0, 100) for c in columns])
        return df.where(wrong).select(F.lit(1).alias("x"))

    rows = (
        outside(marts.sales_monthly, "historical_cost_coverage_pct")
        .union(outside(marts.inventory_health_monthly, "days_cover_coverage_pct"))
        .union(outside(marts.procurement_supplier_monthly, "fill_rate_pct",
                       "within_standard_lead_time_pct"))
        .union(outside(marts.expedition_monthly, "same_day_order_expedition_pct"))
    )
    return _none("percentages", rows, "MART-E050")


PUBLISHED_CHECKS = (
    sales_months, product_sales_months, inventory_months, procurement_supplier_months,
    expedition_months, vehicle_months, published_sales_revenue, published_product_revenue,
    published_gross_profit, published_delivered_units, published_expeditions, published_trips,
    percentages_in_range,
)


def published_checks(core: Core, marts: Marts) -> DataFrame:
    """R10 - R21, one row each."""
    return reduce(DataFrame.unionByName, [check(core, marts) for check in PUBLISHED_CHECKS])


def management_summary(marts: Marts) -> DataFrame:
    """Months, first and last month, revenue and profit."""
    return marts.management_kpis_monthly.agg(
        F.count("*").alias("months"), F.min("month_start").alias("month_min"),
        F.max("month_start").alias("month_max"), F.sum("revenue").alias("revenue"),
        F.sum("gross_profit").alias("gross_profit"))
