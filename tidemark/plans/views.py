"""Report shapes: long series, ranked bars, labelled tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import Marts
from tidemark.plans.serve import mart_row_counts

# --- fixed values: dataset labels ----------------------------------------------------------------
DATASET_LABELS = {
    "sales_monthly": "Mesačný predaj",
    "product_sales_monthly": "Predaj produktov",
    "inventory_health_monthly": "Zdravie skladu",
    "procurement_supplier_monthly": "Výkonnosť dodávateľov",
    "expedition_monthly": "Expedície",
    "vehicle_utilization_monthly": "Využitie vozidiel",
    "management_kpis_monthly": "Manažérske KPI",
}
# -------------------------------------------------------------------------------------------------


def series(monthly: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Wide monthly rows to (month, series, value) without missing values."""
    wide = monthly.select("month_start", *[
        F.col(column).cast("double").alias(label) for column, label in labels.items()])
    return (
        wide.unpivot("month_start", list(labels.values()), "series", "value")
        .where(F.col("value").isNotNull()).withColumnRenamed("month_start", "month")
    )


def ranked_bars(rows: DataFrame, label: str, value: str) -> DataFrame:
    """(category, value) where both are known, largest first."""
    return (
        rows.select(F.col(label).alias("category"), F.col(value).cast("double").alias("value"))
        .dropna().orderBy(F.col("value").desc(), "category")
    )


def report_table(rows: DataFrame, labels: dict[str, str],
                 month_field: str | None = None) -> DataFrame:
    """Chosen columns under report labels, the month as MM/yyyy."""
    return rows.select(*[
        (F.date_format(column, "MM/yyyy") if column == month_field else F.col(column))
        .alias(label) for column, label in labels.items()])


def sales_month_choices(marts: Marts, start: date | None = None) -> DataFrame:
    """Months with sales, from ``start`` on when given."""
    months = marts.management_kpis_monthly.where("revenue is not null").select("month_start")
    if start is not None:
        months = months.where(F.col("month_start") >= F.lit(start))
    return months.orderBy("month_start")


def latest_inventory(inventory: DataFrame) -> DataFrame:
    """The newest inventory record of a range."""
    return inventory.orderBy(F.col("month_start").desc()).limit(1)


def dataset_sizes(marts: Marts) -> DataFrame:
    """Rows per dataset under its label."""
    label = F.create_map(*[F.lit(x) for pair in DATASET_LABELS.items() for x in pair])
    return mart_row_counts(marts).select(
        F.element_at(label, F.col("mart")).alias("dataset"), "row_count")
