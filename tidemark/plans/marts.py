"""The seven monthly marts, in two steps.

Facts are first reduced with map-side combining: to (product, day), (customer, month), (supplier,
month), (vehicle, day) rows.  These reduced tables (``State``) can be merged across batches
by sums and maxima.  Then marts are finished from them: the as-of cost is attached to product days
and months are summed.  No plan here orders or collects a whole group, and building one starts no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import count_true, month_of, percent, ratio, rounded
from tidemark.model import (
    CARRIER, DAYS, DAYS_PER_MONTH, MONEY, OWN, PERCENT, PICKUP, UNIT_PRICE, VOLUME, WEIGHT,
    Core, Marts, State,
)
from tidemark.operators.asof import packed_points, unpacked, with_price_as_of
from tidemark.operators.median import grouped_median

_AMOUNT = T.DecimalType(38, 2)
_DAYS_OF_COVER = T.DecimalType(28, 10)


def _line_cents(quantity: str, price: str) -> Column:
    """Quantity times a two-place price in whole cents: sums of longs stay in codegen."""
    return F.col(quantity).cast("bigint") * (F.col(price) * 100).cast("bigint")


def _amount(cents: str) -> Column:
    """A sum of cents (a decimal or a long) as an exact amount."""
    return (F.col(cents).cast("decimal(36,0)") * F.lit("0.01").cast("decimal(2,2)")
            ).cast(_AMOUNT)


# --- facts reduced ----------------------------------------------------------------------------

def sales_lines(core: Core) -> DataFrame:
    """Sales lines with the header fields the marts need."""
    headers = core.sales_orders.select("order_id", "order_date", "customer_id")
    lines = core.sales_order_lines.select("order_id", "product_id", "quantity", "unit_price")
    return lines.join(headers, "order_id").withColumn("month_start", month_of(F.col("order_date")))


def product_days(core: Core) -> DataFrame:
    """Sales lines summed per product and day."""
    return sales_lines(core).groupBy("month_start", "product_id", "order_date").agg(
        F.sum("quantity").alias("units"),
        F.sum(_line_cents("quantity", "unit_price")).alias("revenue_cents"),
        F.count("*").alias("line_count"),
    )


def customer_months(core: Core) -> DataFrame:
    """Orders with lines per customer and month: an order has one customer and one date."""
    return sales_lines(core).select("order_id", "customer_id", "month_start").distinct().groupBy(
        "month_start", "customer_id").agg(F.count("*").alias("orders"))


def product_customers(core: Core) -> DataFrame:
    """Orders per product, customer and month."""
    return sales_lines(core).select("order_id", "product_id", "customer_id", "month_start").distinct().groupBy(
        "month_start", "product_id", "customer_id").agg(F.count("*").alias("orders"))


def reduced(core: Core, facts: Core | None = None) -> State:
    """The facts of ``facts`` (all of ``core`` by default) reduced; master data and headers are looked up in ``core``."""
    facts = core if facts is None else facts
    return State(
        product_days=lambda: product_days(facts),
        customer_months=lambda: customer_months(facts),
        product_customers=lambda: product_customers(facts),
        price_points=lambda: packed_points(facts.purchase_orders, facts.purchase_order_lines),
        supplier_totals=lambda: supplier_totals(facts.replace(products=core.products)),
        shipment_totals=lambda: shipment_totals(facts.replace(sales_orders=core.sales_orders)),
        picking_times=lambda: picking_times(facts),
        vehicle_days=lambda: vehicle_days(facts.replace(vehicles=core.vehicles)),
    )


# --- M00: as-of cost --------------------------------------------------------------------------

def costed_product_days(core: Core, state: State | None = None) -> DataFrame:
    """Product days with unit cost: as-of purchase price, else the product's master price."""
    state = reduced(core) if state is None else state
    master = core.products.select("product_id", "purchase_price")
    historical = F.col("historical_price")
    return (
        with_price_as_of(state.product_days, unpacked(state.price_points), "order_date")
        .join(master, "product_id")
        .withColumn("has_historical_cost", historical.isNotNull())
        .withColumn("unit_cost", F.coalesce(historical, "purchase_price"))
        .withColumn("cost_cents", _line_cents("units", "unit_cost"))
    )


def as_of_unit_cost(core: Core) -> DataFrame:
    """M00 as a result of its own: unit cost per product and sales day."""
    return costed_product_days(core).select(
        "product_id", "order_date", "unit_cost", "has_historical_cost")


def _cost_sums(days: DataFrame, *keys: Column | str) -> DataFrame:
    """Product days to coarser keys; amounts become decimals so that totals cannot overflow."""
    historical = F.when(F.col("has_historical_cost"), F.col("line_count")).otherwise(0)
    whole = "decimal(18,0)"
    return (
        days.groupBy(*keys).agg(
            F.sum(F.col("revenue_cents").cast(whole)).alias("revenue_cents"),
            F.sum(F.col("cost_cents").cast(whole)).alias("cost_cents"),
            F.sum("units").alias("units"), F.sum("line_count").alias("lines"),
            F.sum(historical).alias("historical_lines"))
        .withColumn("revenue", _amount("revenue_cents"))
        .withColumn("cost", _amount("cost_cents"))
    )


def _profit() -> Column:
    return F.col("revenue") - F.col("cost")


# --- M01 / M02: sales -------------------------------------------------------------------------

def sales_monthly(core: Core, state: State | None = None,
                  costed: DataFrame | None = None) -> DataFrame:
    state = reduced(core) if state is None else state
    costed = costed_product_days(core, state) if costed is None else costed
    money = _cost_sums(costed, "month_start")
    buyers = state.customer_months.groupBy("month_start").agg(
        F.sum("orders").alias("order_count"), F.count("customer_id").alias("customer_count"))
    return money.join(buyers, "month_start").select(
        "month_start",
        rounded(F.col("revenue"), MONEY).alias("revenue"),
        rounded(F.col("cost"), MONEY).alias("estimated_cost"),
        rounded(_profit(), MONEY).alias("gross_profit"),
        percent(_profit(), F.col("revenue"), PERCENT).alias("gross_margin_pct"),
        F.col("units").alias("units_sold"),
        "order_count",
        "customer_count",
        ratio(F.col("revenue"), F.col("order_count"), MONEY).alias("average_order_value"),
        F.col("lines").alias("sales_line_count"),
        F.col("historical_lines").alias("historical_cost_line_count"),
        (F.col("lines") - F.col("historical_lines")).alias("fallback_cost_line_count"),
        percent(F.col("historical_lines"), F.col("lines"), PERCENT)
        .alias("historical_cost_coverage_pct"),
    )


def product_sales_monthly(core: Core, state: State | None = None,
                          costed: DataFrame | None = None) -> DataFrame:
    state = reduced(core) if state is None else state
    costed = costed_product_days(core, state) if costed is None else costed
    keys = ["month_start", "product_id"]
    money = _cost_sums(costed, *keys)
    buyers = state.product_customers.groupBy(*keys).agg(
        F.sum("orders").alias("order_count"), F.count("customer_id").alias("customer_count"))
    catalogue = core.products.select("product_id", "product_name", "category", "supplier_id")
    names = core.suppliers.select(F.col("id").alias("supplier_id"), "supplier_name")
    return (
        money.join(buyers, keys).join(catalogue, "product_id").join(names, "supplier_id")
        .select(
            "month_start", "product_id", "product_name", "category", "supplier_name",
            F.col("units").alias("units_sold"), "order_count", "customer_count",
            rounded(F.col("revenue"), MONEY).alias("revenue"),
            rounded(F.col("cost"), MONEY).alias("estimated_cost"),
            rounded(_profit(), MONEY).alias("gross_profit"),
            percent(_profit(), F.col("revenue"), PERCENT).alias("gross_margin_pct"),
            ratio(F.col("revenue"), F.col("units"), UNIT_PRICE).alias("average_unit_price"),
            percent(F.col("historical_lines"), F.col("lines"), PERCENT)
            .alias("historical_cost_coverage_pct"),
        )
    )


# --- M03: inventory ---------------------------------------------------------------------------

def monthly_units(core: Core, state: State | None = None) -> DataFrame:
    """Units sold per month and product."""
    state = reduced(core) if state is None else state
    return state.product_days.groupBy("month_start", "product_id").agg(
        F.sum("units").alias("units_sold"))


def stock_lines(core: Core) -> DataFrame:
    """Stock lines with their snapshot date as the month."""
    dates = core.inventory_snapshots.select(F.col("id").alias("snapshot_id"), "snapshot_date")
    return (
        core.inventory_snapshot_lines
        .select("snapshot_id", "product_id", "stock_available", "min_stock", "max_stock")
        .join(dates, "snapshot_id")
        .select("product_id", F.col("snapshot_date").alias("month_start"), "stock_available",
                "min_stock", "max_stock")
    )


def _cover() -> Column:
    cover = (
        F.col("stock_available").cast("decimal(16,0)")
        * F.lit(DAYS_PER_MONTH).cast("decimal(6,4)")
        / F.nullif(F.col("units_sold"), F.lit(0)).cast("decimal(12,0)")
    )
    return F.when(F.col("units_sold") > 0, cover.cast(_DAYS_OF_COVER)).alias("days_of_cover")


def inventory_detail(core: Core, state: State | None = None,
                     stock: DataFrame | None = None) -> DataFrame:
    """Stock lines with unit cost, month sales and days of cover.

    The snapshot date is used as the month as it stands: a snapshot taken inside a month meets
    no month sales and so has no days of cover.
    """
    state = reduced(core) if state is None else state
    stock = stock_lines(core) if stock is None else stock
    master = core.products.select("product_id", "purchase_price", "sales_price")
    return (
        with_price_as_of(stock, unpacked(state.price_points), "month_start", on_day=monthly_units(core, state))
        .join(master, "product_id")
        .select(
            "month_start", "product_id", "stock_available", "min_stock", "max_stock",
            "sales_price", F.coalesce("historical_price", "purchase_price").alias("unit_cost"),
            F.col("historical_price").isNotNull().alias("has_historical_cost"), "units_sold",
            _cover(),
        )
    )


def days_of_cover(core: Core, state: State, stock: DataFrame) -> DataFrame:
    """The stock lines that have days of cover, as far as a median needs them: no cost, no master data."""
    sold = monthly_units(core, state).where("units_sold > 0")
    return stock.join(sold, ["month_start", "product_id"]).select("month_start", _cover())


def inventory_health_monthly(core: Core, state: State | None = None,
                             stock: DataFrame | None = None, detail: DataFrame | None = None) -> DataFrame:
    """``detail``: ``inventory_detail`` as stored, so that sums and medians read its lines and none are joined again."""
    state = reduced(core) if state is None else state
    stock = stock_lines(core) if stock is None else stock
    lines = inventory_detail(core, state, stock) if detail is None else detail
    available, low, high = F.col("stock_available"), F.col("min_stock"), F.col("max_stock")
    sold = F.col("units_sold")
    sums = lines.groupBy("month_start").agg(
        F.count("*").alias("product_count"),
        count_true(available == 0).alias("stockout_products"),
        count_true(available < low).alias("below_min_products"),
        count_true(available > high).alias("above_max_products"),
        count_true(available.between(low, high)).alias("healthy_products"),
        F.sum(available * F.col("unit_cost")).alias("cost_value"),
        F.sum(available * F.col("sales_price")).alias("sales_value"),
        count_true(sold > 0).alias("products_with_month_sales"),
        count_true(F.coalesce(sold, F.lit(0)) == 0).alias("products_without_month_sales"),
        count_true(F.col("has_historical_cost")).alias("historical_cost_product_count"),
        F.sum("days_of_cover").alias("cover_sum"),
        F.count("days_of_cover").alias("cover_count"),
    )
    # Every stock line has a product (a constraint of the core), so the median needs no master data.
    covers = days_of_cover(core, state, stock) if detail is None else detail.select("month_start", "days_of_cover")
    medians = grouped_median(covers, ["month_start"], "days_of_cover", "cover_median")
    return sums.join(medians, "month_start", "left").select(
        "month_start", "product_count", "stockout_products", "below_min_products",
        "above_max_products", "healthy_products",
        rounded(F.col("cost_value"), MONEY).alias("inventory_cost_value"),
        rounded(F.col("sales_value"), MONEY).alias("inventory_sales_value"),
        rounded(F.col("sales_value") - F.col("cost_value"), MONEY)
        .alias("inventory_potential_margin_value"),
        "products_with_month_sales", "products_without_month_sales",
        "historical_cost_product_count",
        (F.col("product_count") - F.col("historical_cost_product_count"))
        .alias("fallback_cost_product_count"),
        percent(F.col("products_with_month_sales"), F.col("product_count"), PERCENT)
        .alias("days_cover_coverage_pct"),
        rounded(F.col("cover_sum") / F.nullif(F.col("cover_count"), F.lit(0))
                .cast("decimal(12,0)"), DAYS).alias("average_days_of_cover"),
        rounded(F.col("cover_median"), DAYS).alias("median_days_of_cover"),
    )


# --- M04: procurement -------------------------------------------------------------------------

def supplier_totals(core: Core) -> DataFrame:
    """Purchases summed per month and supplier."""
    headers = core.purchase_orders.select("purchase_order_id", "order_date", "supplier_id")
    lines = core.purchase_order_lines.select(
        "purchase_order_id", "product_id", "delivery_date", "ordered_quantity",
        "delivered_quantity", "purchase_price")
    standard = core.products.select("product_id", "lead_time_days")
    lead = F.date_diff("delivery_date", "order_date")
    joined = lines.join(headers, "purchase_order_id").join(standard, "product_id")
    # Orders first (an order has one supplier and one date), then months: the distinct count of
    # orders is a plain count of the first level.
    per_order = joined.groupBy(
        month_of(F.col("order_date")).alias("month_start"), "supplier_id", "purchase_order_id",
    ).agg(
        F.count("*").alias("lines"),
        F.sum("ordered_quantity").alias("ordered"),
        F.sum("delivered_quantity").alias("delivered"),
        F.sum(_line_cents("ordered_quantity", "purchase_price")).alias("ordered_cents"),
        F.sum(_line_cents("delivered_quantity", "purchase_price")).alias("delivered_cents"),
        F.sum(lead).alias("lead"), F.sum("lead_time_days").alias("standard_lead"),
        count_true(lead <= F.col("lead_time_days")).alias("in_time"),
        count_true(lead > F.col("lead_time_days")).alias("late"),
    )
    sums = ("lines", "ordered", "delivered", "lead", "standard_lead", "in_time", "late")
    cents = ("ordered_cents", "delivered_cents")
    return per_order.groupBy("month_start", "supplier_id").agg(
        F.count("*").alias("orders"), *[F.sum(c).alias(c) for c in sums],
        *[F.sum(F.col(c).cast("decimal(18,0)")).cast("decimal(34,0)").alias(c) for c in cents])


def procurement_supplier_monthly(core: Core, state: State | None = None) -> DataFrame:
    totals = (reduced(core) if state is None else state).supplier_totals
    names = core.suppliers.select(F.col("id").alias("supplier_id"), "supplier_name")
    lines_count = F.col("lines")
    return totals.join(names, "supplier_id").select(
        "month_start", "supplier_id", "supplier_name",
        F.col("orders").alias("purchase_order_count"),
        lines_count.alias("purchase_line_count"),
        F.col("ordered").alias("ordered_units"),
        F.col("delivered").alias("delivered_units"),
        (F.col("ordered") - F.col("delivered")).alias("undelivered_units"),
        rounded(_amount("ordered_cents"), MONEY).alias("ordered_value"),
        rounded(_amount("delivered_cents"), MONEY).alias("delivered_value"),
        percent(F.col("delivered"), F.col("ordered"), PERCENT).alias("fill_rate_pct"),
        ratio(F.col("lead"), lines_count, DAYS).alias("average_actual_lead_time_days"),
        ratio(F.col("standard_lead"), lines_count, DAYS)
        .alias("average_standard_lead_time_days"),
        percent(F.col("in_time"), lines_count, PERCENT).alias("within_standard_lead_time_pct"),
        F.col("late").alias("late_line_count"),
    )


# --- M05: expedition --------------------------------------------------------------------------

def _picking() -> Column:
    return F.timestamp_diff("MICROSECOND", F.col("received_at"), F.col("picked_at")).alias("picking")


def shipment_totals(core: Core) -> DataFrame:
    """Shipments summed per month."""
    orders = core.sales_orders.select("order_id", "order_date")
    kind = F.col("delivery_type")
    return (
        core.expeditions.join(orders, "order_id")
        .select(month_of(F.col("expedition_date")).alias("month_start"), "delivery_type",
                "weight_kg", "volume_m3", _picking(),
                F.date_diff("expedition_date", "order_date").alias("days"))
        .groupBy("month_start").agg(
            F.count("*").alias("expedition_count"),
            count_true(kind == OWN).alias("own_delivery_expeditions"),
            count_true(kind == CARRIER).alias("external_delivery_expeditions"),
            count_true(kind == PICKUP).alias("pickup_expeditions"),
            F.sum("weight_kg").cast("decimal(28,2)").alias("weight"),
            F.sum("volume_m3").cast("decimal(28,3)").alias("volume"),
            F.sum(F.col("picking").cast("decimal(20,0)")).cast("decimal(30,0)").alias("picking"),
            F.count("picking").alias("picked"),
            F.sum("days").alias("days"),
            count_true(F.col("days") == 0).alias("same_day"))
    )


def picking_times(core: Core) -> DataFrame:
    """How often each picking time, a missing one too, occurs in a month.  A shipment has an order (a constraint)."""
    return core.expeditions.select(
        month_of(F.col("expedition_date")).alias("month_start"), _picking()).groupBy("month_start", "picking").agg(F.count("*").alias("n"))


def expedition_monthly(core: Core, state: State | None = None) -> DataFrame:
    state = reduced(core) if state is None else state
    medians = grouped_median(state.picking_times, ["month_start"], "picking", "picking_median", "n")
    count = F.col("expedition_count")
    hour = F.lit(3_600_000_000).cast("decimal(10,0)")
    return state.shipment_totals.join(medians, "month_start", "left").select(
        "month_start", "expedition_count", "own_delivery_expeditions",
        "external_delivery_expeditions", "pickup_expeditions",
        rounded(F.col("weight"), WEIGHT).alias("total_weight_kg"),
        rounded(F.col("volume"), VOLUME).alias("total_volume_m3"),
        ratio(F.col("picking") / hour, F.col("picked"), DAYS).alias("average_picking_hours"),
        rounded(F.col("picking_median") / hour, DAYS).alias("median_picking_hours"),
        ratio(F.col("days"), count, DAYS).alias("average_order_to_expedition_days"),
        percent(F.col("same_day"), count, PERCENT).alias("same_day_order_expedition_pct"),
    )


# --- M06: vehicles ----------------------------------------------------------------------------

def vehicle_days(core: Core) -> DataFrame:
    """Trips with the own fleet summed per vehicle and day."""
    own = core.expeditions.where(F.col("delivery_type") == OWN).select(
        "vehicle_id", "expedition_date", "weight_kg", "volume_m3")
    limits = core.vehicles.select("vehicle_id", "capacity_kg", "capacity_m3")
    too_much = ((F.col("weight_kg") > F.col("capacity_kg"))
                | (F.col("volume_m3") > F.col("capacity_m3")))
    return (
        own.join(limits, "vehicle_id")
        .groupBy("vehicle_id", "expedition_date").agg(
            F.count("*").alias("trips"),
            F.sum("weight_kg").cast("decimal(24,2)").alias("weight"),
            F.sum("volume_m3").cast("decimal(24,3)").alias("volume"),
            F.max("weight_kg").alias("top_weight"), F.max("volume_m3").alias("top_volume"),
            count_true(too_much).alias("overloaded"))
    )


def vehicle_utilization_monthly(core: Core, state: State | None = None) -> DataFrame:
    """Dense months x vehicles.

    The months are one bounded array (a scalar subquery over the calendar) exploded onto the
    fleet; trips are reduced per vehicle and day before they meet that grid.
    """
    state = reduced(core) if state is None else state
    fleet = core.vehicles.select("vehicle_id", "driver", "capacity_kg", "capacity_m3")
    months = state.picking_times.select("month_start").distinct().agg(F.collect_set("month_start"))
    grid = fleet.select("*", F.explode(months.scalar()).alias("month_start"))
    trips = state.vehicle_days.groupBy(
        "vehicle_id", month_of(F.col("expedition_date")).alias("month_start")).agg(
        F.sum("trips").alias("trips"), F.count("*").alias("days"),
        F.sum("weight").alias("weight"), F.sum("volume").alias("volume"),
        F.max("top_weight").alias("top_weight"), F.max("top_volume").alias("top_volume"),
        F.sum("overloaded").alias("overloaded"))
    count = F.col("trips")
    zero = F.lit(0)
    return grid.join(trips, ["month_start", "vehicle_id"], "left").select(
        "month_start", "vehicle_id", "driver", "capacity_kg", "capacity_m3",
        F.coalesce(count, zero.cast("bigint")).alias("trip_count"),
        F.coalesce("days", zero.cast("bigint")).alias("active_day_count"),
        rounded(F.coalesce("weight", zero), WEIGHT).alias("transported_weight_kg"),
        rounded(F.coalesce("volume", zero), VOLUME).alias("transported_volume_m3"),
        percent(F.col("weight"), count * F.col("capacity_kg"), PERCENT)
        .alias("average_weight_utilization_pct"),
        percent(F.col("volume"), count * F.col("capacity_m3"), PERCENT)
        .alias("average_volume_utilization_pct"),
        percent(F.col("top_weight"), F.col("capacity_kg"), PERCENT)
        .alias("maximum_weight_utilization_pct"),
        percent(F.col("top_volume"), F.col("capacity_m3"), PERCENT)
        .alias("maximum_volume_utilization_pct"),
        F.coalesce("overloaded", zero.cast("bigint")).alias("overloaded_trips"),
    )


# --- M07: management --------------------------------------------------------------------------

def mart_months(sales: DataFrame, inventory: DataFrame, procurement: DataFrame,
                expedition: DataFrame) -> DataFrame:
    """The distinct months of the four marts that drive the spine."""
    month = "month_start"
    return (
        sales.select(month).union(inventory.select(month)).union(procurement.select(month))
        .union(expedition.select(month)).distinct()
    )


def month_spine(months: DataFrame) -> DataFrame:
    """Every month from the first to the last, gaps included."""
    bounds = months.agg(F.min("month_start").alias("a"), F.max("month_start").alias("b"))
    return bounds.where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month_start"))


def procurement_by_month(procurement: DataFrame) -> DataFrame:
    """Supplier rows to months; lead time weighted by the number of lines."""
    lines = F.col("purchase_line_count").cast("decimal(18,0)")
    weighted = F.col("average_actual_lead_time_days") * lines
    return procurement.groupBy("month_start").agg(
        rounded(F.sum("delivered_value"), MONEY).alias("procurement_delivered_value"),
        percent(F.sum("delivered_units"), F.sum("ordered_units"), PERCENT)
        .alias("procurement_fill_rate_pct"),
        ratio(F.sum(weighted), F.sum("purchase_line_count"), DAYS)
        .alias("average_procurement_lead_time_days"),
        percent(F.sum(F.col("purchase_line_count") - F.col("late_line_count")),
                F.sum("purchase_line_count"), PERCENT).alias("procurement_within_standard_pct"),
    )


def fleet_by_month(vehicles: DataFrame) -> DataFrame:
    """M07d: vehicle rows to months; utilization weighted by trips (vehicles without a value
    drop out of the sum)."""
    trips = F.col("trip_count").cast("decimal(18,0)")
    return vehicles.groupBy("month_start").agg(
        F.sum("trip_count").alias("own_fleet_trip_count"),
        ratio(F.sum(F.col("average_weight_utilization_pct") * trips), F.sum("trip_count"),
              PERCENT).alias("average_vehicle_weight_utilization_pct"),
        ratio(F.sum(F.col("average_volume_utilization_pct") * trips), F.sum("trip_count"),
              PERCENT).alias("average_vehicle_volume_utilization_pct"),
    )


def management_kpis_monthly(sales: DataFrame, inventory: DataFrame, procurement: DataFrame,
                            expedition: DataFrame, vehicles: DataFrame) -> DataFrame:
    month = "month_start"
    spine = month_spine(mart_months(sales, inventory, procurement, expedition))
    return (
        spine
        .join(sales.select(
            month, "revenue", "estimated_cost", "gross_profit", "gross_margin_pct",
            "units_sold", F.col("order_count").alias("sales_order_count"), "customer_count",
        ), month, "left")
        .join(inventory.select(
            month, "inventory_cost_value", "stockout_products", "below_min_products",
            "above_max_products", "average_days_of_cover",
        ), month, "left")
        .join(procurement_by_month(procurement), month, "left")
        .join(expedition.select(
            month, "expedition_count", "own_delivery_expeditions",
            "external_delivery_expeditions", "pickup_expeditions", "average_picking_hours",
        ), month, "left")
        .join(fleet_by_month(vehicles), month, "left")
    )


def all_marts(core: Core, state: State | None = None) -> Marts:
    """The plans of all seven marts."""
    state = reduced(core) if state is None else state
    costed = costed_product_days(core, state)
    sales = sales_monthly(core, state, costed)
    inventory = inventory_health_monthly(core, state)
    procurement = procurement_supplier_monthly(core, state)
    expedition = expedition_monthly(core, state)
    vehicles = vehicle_utilization_monthly(core, state)
    return Marts(
        sales_monthly=sales,
        product_sales_monthly=product_sales_monthly(core, state, costed),
        inventory_health_monthly=inventory,
        procurement_supplier_monthly=procurement,
        expedition_monthly=expedition,
        vehicle_utilization_monthly=vehicles,
        management_kpis_monthly=management_kpis_monthly(
            sales, inventory, procurement, expedition, vehicles),
    )
