"""Read queries over published marts: functions from marts and parameters to DataFrames."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import percent, ratio, rounded
from tidemark.model import DAYS, MART_TABLES, MONEY, PERCENT, UNIT_PRICE, VOLUME, WEIGHT, Marts

# --- fixed values ------------------------------------------------------------------------------
RANGED_MARTS = (
    "management_kpis_monthly", "product_sales_monthly", "inventory_health_monthly",
    "procurement_supplier_monthly", "expedition_monthly", "vehicle_utilization_monthly",
)
PRODUCT_SORTS = ("revenue", "gross_profit", "gross_margin_pct", "units_sold", "order_count")
COMPARED_KPIS = (
    "revenue", "gross_profit", "units_sold", "sales_order_count", "customer_count",
    "inventory_cost_value", "expedition_count",
)
MAX_LIMIT = 100
# -----------------------------------------------------------------------------------------------


class MartEmpty(Exception):
    """The mart holds no months yet."""


class NotAvailable(Exception):
    """The requested month is not in the mart."""


def first_of_month(day: date | None) -> date | None:
    return None if day is None else day.replace(day=1)


def range_bounds(mart: DataFrame) -> DataFrame:
    return mart.agg(F.min("month_start").alias("month_min"),
                    F.max("month_start").alias("month_max"))


def resolve_range(marts: Marts, name: str, date_from: date | None = None,
                  date_to: date | None = None) -> tuple[date, date]:
    """Q00: snap to month starts, default to the mart's own first and last month."""
    if name not in RANGED_MARTS:
        raise ValueError(f"unsupported mart {name!r}")
    bounds = range_bounds(getattr(marts, name)).first()
    if bounds.month_min is None:
        raise MartEmpty(name)
    low = first_of_month(date_from) or bounds.month_min
    high = first_of_month(date_to) or bounds.month_max
    if low > high:
        raise ValueError("date_from must not be after date_to")
    return low, high


def _ranged(marts: Marts, name: str, date_from: date | None, date_to: date | None) -> DataFrame:
    low, high = resolve_range(marts, name, date_from, date_to)
    return getattr(marts, name).where(F.col("month_start").between(low, high))


def _limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def mart_row_counts(marts: Marts) -> DataFrame:
    """Rows per mart as (mart, row_count)."""
    counted = [df.agg(F.lit(name).alias("mart"), F.count("*").alias("row_count"))
               for name, df in marts.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


def status(marts: Marts, runs: DataFrame) -> DataFrame:
    """Q01: newest run, rows per mart, covered months, ready or not; one row."""
    kpis = marts.management_kpis_monthly
    with_sales = F.when(F.col("revenue").isNotNull(), F.col("month_start"))
    counts = {name: df.agg(F.count("*")).scalar() for name, df in marts.items()}
    latest = runs.agg(F.max_by("status", "started_at")).scalar()
    ready = F.coalesce(latest == "completed", F.lit(False))
    return kpis.agg(
        F.min("month_start").alias("month_min"), F.max("month_start").alias("month_max"),
        F.min(with_sales).alias("sales_month_min"), F.max(with_sales).alias("sales_month_max"),
    ).select(
        F.when(ready, "ready").otherwise("not_ready").alias("status"),
        latest.alias("latest_refresh_status"), "*",
        *[counts[name].alias(f"{name}_rows") for name in MART_TABLES],
    )


def percentage_change(current: Column, previous: Column) -> Column:
    """Change in percent at two places; null without a usable previous value."""
    now, before = current.cast("double"), F.nullif(previous.cast("double"), F.lit(0.0))
    return F.bround(F.lit(100.0) * (now - before) / before, 2)


def latest_sales_month(marts: Marts) -> date:
    row = marts.management_kpis_monthly.where("revenue is not null").agg(
        F.max("month_start").alias("m")).first()
    if row.m is None:
        raise MartEmpty("management_kpis_monthly")
    return row.m


def summary(marts: Marts, month: date | None = None) -> DataFrame:
    """Q02: the selected month beside the calendar month before and the month a year before.

    One row of structs: current, previous_month, previous_year, month_over_month_pct,
    year_over_year_pct.  The offsets are calendar offsets, not row offsets.
    """
    kpis = marts.management_kpis_monthly
    selected = first_of_month(month) or latest_sales_month(marts)
    current = kpis.where(F.col("month_start") == F.lit(selected))
    if current.isEmpty():
        raise NotAvailable(str(selected))
    # At most three rows: the month filters reach the scan.
    wanted = {"current": 0, "previous_month": -1, "previous_year": -12}
    offset = F.create_map(*[
        part for name, months in wanted.items()
        for part in (F.add_months(F.lit(selected), months), F.lit(name))])
    rows = kpis.where(F.col("month_start").isin(
        [_shift(selected, months) for months in wanted.values()]))
    record = F.struct(*kpis.columns)
    picked = rows.groupBy().agg(*[
        F.max(F.when(F.element_at(offset, F.col("month_start")) == name, record)).alias(name)
        for name in wanted])

    def changes(other: str) -> Column:
        return F.struct(*[
            percentage_change(F.col(f"current.{k}"), F.col(f"{other}.{k}")).alias(k)
            for k in COMPARED_KPIS])

    return picked.select(
        F.lit(selected).alias("selected_month"), *wanted,
        changes("previous_month").alias("month_over_month_pct"),
        changes("previous_year").alias("year_over_year_pct"))


def _shift(month: date, months: int) -> date:
    index = month.year * 12 + month.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def monthly(marts: Marts, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """Q03: management KPIs in a range."""
    return _ranged(marts, "management_kpis_monthly", date_from, date_to).orderBy("month_start")


def product_ranking(marts: Marts, date_from: date | None = None, date_to: date | None = None,
                    category: str | None = None, supplier: str | None = None,
                    sort_by: str = "revenue", direction: str = "desc",
                    limit: int = 20) -> DataFrame:
    """Q04: products over a range.  Customers are the sum of the monthly distinct counts.

    A missing margin counts as the largest value, as in the source system: first when
    descending, last when ascending.
    """
    rows = _ranged(marts, "product_sales_monthly", date_from, date_to)
    if sort_by not in PRODUCT_SORTS:
        raise ValueError("unsupported sort_by value")
    direction = direction.lower()
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be asc or desc")
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if supplier is not None:
        rows = rows.where(F.col("supplier_name") == supplier)
    sort = F.col(sort_by)
    order = sort.desc_nulls_first() if direction == "desc" else sort.asc_nulls_last()
    sums = rows.groupBy("product_id", "product_name", "category", "supplier_name").agg(*[
        F.sum(c).alias(c) for c in ("units_sold", "order_count", "customer_count", "revenue",
                                    "estimated_cost", "gross_profit")])
    return sums.select(
        "product_id", "product_name", "category", "supplier_name", "units_sold", "order_count",
        "customer_count", rounded(F.col("revenue"), MONEY).alias("revenue"),
        rounded(F.col("estimated_cost"), MONEY).alias("estimated_cost"),
        rounded(F.col("gross_profit"), MONEY).alias("gross_profit"),
        percent(F.col("gross_profit"), F.col("revenue"), PERCENT).alias("gross_margin_pct"),
        ratio(F.col("revenue"), F.col("units_sold"), UNIT_PRICE).alias("average_unit_price"),
    ).orderBy(order, F.col("product_id").asc()).limit(_limit(limit))


def filter_values(marts: Marts, date_from: date | None = None,
                  date_to: date | None = None) -> DataFrame:
    """Q05 as rows: (kind, value) of the distinct categories and suppliers, however many there are."""
    rows = _ranged(marts, "product_sales_monthly", date_from, date_to)
    pairs = rows.select("category", "supplier_name").distinct()
    return pairs.select(F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("supplier").alias("kind"), F.col("supplier_name").alias("value")))).alias("v")).select(
        "v.*").where("value is not null").distinct()


def filter_options(marts: Marts, date_from: date | None = None,
                   date_to: date | None = None) -> DataFrame:
    """Q05 as a report: sorted distinct categories and suppliers as arrays, null when there are none.

    One row for a form to choose from; ``filter_values`` has the same without gathering it.
    """
    def values(kind: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))
        return F.when(F.size(found) > 0, found)

    return filter_values(marts, date_from, date_to).agg(
        values("category").alias("categories"), values("supplier").alias("suppliers"))


def inventory(marts: Marts, date_from: date | None = None,
              date_to: date | None = None) -> DataFrame:
    """Q06: inventory health in a range."""
    return _ranged(marts, "inventory_health_monthly", date_from, date_to).orderBy("month_start")


def supplier_ranking(marts: Marts, date_from: date | None = None, date_to: date | None = None,
                     limit: int = 20) -> DataFrame:
    """Q07: suppliers over a range; means weighted by lines, fill rate from the sums."""
    rows = _ranged(marts, "procurement_supplier_monthly", date_from, date_to)
    weight = F.col("purchase_line_count").cast("decimal(18,0)")
    sums = rows.groupBy("supplier_id", "supplier_name").agg(
        *[F.sum(c).alias(c) for c in (
            "purchase_order_count", "purchase_line_count", "ordered_units", "delivered_units",
            "undelivered_units", "ordered_value", "delivered_value", "late_line_count")],
        F.sum(F.col("average_actual_lead_time_days") * weight).alias("actual"),
        F.sum(F.col("average_standard_lead_time_days") * weight).alias("standard"))
    lines = F.col("purchase_line_count")
    return sums.select(
        "supplier_id", "supplier_name", "purchase_order_count", "purchase_line_count",
        "ordered_units", "delivered_units", "undelivered_units",
        rounded(F.col("ordered_value"), MONEY).alias("ordered_value"),
        rounded(F.col("delivered_value"), MONEY).alias("delivered_value"),
        percent(F.col("delivered_units"), F.col("ordered_units"), PERCENT)
        .alias("fill_rate_pct"),
        ratio(F.col("actual"), lines, DAYS).alias("average_actual_lead_time_days"),
        ratio(F.col("standard"), lines, DAYS).alias("average_standard_lead_time_days"),
        percent(lines - F.col("late_line_count"), lines, PERCENT)
        .alias("within_standard_lead_time_pct"),
        "late_line_count",
    ).orderBy(F.col("delivered_value").desc_nulls_first(), F.col("supplier_name").asc()
              ).limit(_limit(limit))


def expeditions(marts: Marts, date_from: date | None = None,
                date_to: date | None = None) -> DataFrame:
    """Q08: expeditions in a range."""
    return _ranged(marts, "expedition_monthly", date_from, date_to).orderBy("month_start")


def vehicles(marts: Marts, date_from: date | None = None,
             date_to: date | None = None) -> DataFrame:
    """Q09: fleet over a range; mean utilization weighted by trips."""
    rows = _ranged(marts, "vehicle_utilization_monthly", date_from, date_to)
    trips = F.col("trip_count").cast("decimal(18,0)")
    sums = rows.groupBy("vehicle_id", "driver").agg(
        F.max("capacity_kg").alias("capacity_kg"), F.max("capacity_m3").alias("capacity_m3"),
        *[F.sum(c).alias(c) for c in ("trip_count", "active_day_count", "transported_weight_kg",
                                      "transported_volume_m3", "overloaded_trips")],
        F.sum(F.col("average_weight_utilization_pct") * trips).alias("w"),
        F.sum(F.col("average_volume_utilization_pct") * trips).alias("v"),
        F.max("maximum_weight_utilization_pct").alias("maximum_weight_utilization_pct"),
        F.max("maximum_volume_utilization_pct").alias("maximum_volume_utilization_pct"))
    count = F.col("trip_count")
    return sums.select(
        "vehicle_id", "driver", "capacity_kg", "capacity_m3", "trip_count", "active_day_count",
        rounded(F.col("transported_weight_kg"), WEIGHT).alias("transported_weight_kg"),
        rounded(F.col("transported_volume_m3"), VOLUME).alias("transported_volume_m3"),
        ratio(F.col("w"), count, PERCENT).alias("average_weight_utilization_pct"),
        ratio(F.col("v"), count, PERCENT).alias("average_volume_utilization_pct"),
        "maximum_weight_utilization_pct", "maximum_volume_utilization_pct", "overloaded_trips",
    ).orderBy(F.col("trip_count").desc_nulls_first(), F.col("vehicle_id").asc())
