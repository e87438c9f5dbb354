"""Table layouts and fixed vocabularies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: domain vocabularies -------------------------------------------------------
REGIONS = ("BA", "BB", "KE", "NR", "PO", "TN", "TT", "ZA")
ORDER_STATUSES = ("vybavená",)
OWN, CARRIER, PICKUP = "vlastná", "externá", "osobný odber"
DELIVERY_TYPES = (OWN, CARRIER, PICKUP)
AVAILABILITIES = ("pondelok-piatok", "pondelok-sobota", "podľa objednávky")
UNITS = ("ks", "bal", "rolka", "vedro", "sada", "m2", "m")
REQUIRED_WORDS = ("áno", "ano", "yes", "true", "1")
BATCH_STATUSES = (
    "registered", "validating", "raw_loaded", "staging_loaded", "completed", "rejected", "failed",
)
SEVERITIES = ("ERROR", "WARNING", "INFO")
DAYS_PER_MONTH = "30.4375"
# ---------------------------------------------------------------------------------------------

# --- fixed values: sheet contracts (column, declared type, nullable) --------------------------
SHEETS: dict[str, tuple[tuple[str, str, bool], ...]] = {
    "products": (
        ("product_id", "text", False), ("product_name", "text", False),
        ("category", "text", False), ("unit", "text", False),
        ("purchase_price", "decimal(10,2)", False), ("sales_price", "decimal(10,2)", False),
        ("supplier", "text", False), ("minimum_order_quantity", "integer", False),
        ("lead_time_days", "integer", False), ("weight_kg", "decimal(10,3)", False),
        ("volume_m3", "decimal(10,5)", False),
    ),
    "sales": (
        ("order_id", "text", False), ("order_date", "date", False),
        ("product_id", "text", False), ("quantity", "integer", False),
        ("unit_price", "decimal(10,2)", False), ("customer_id", "text", False),
        ("customer_name", "text", False), ("region", "text", False),
        ("order_status", "text", False), ("expedition_date", "date", False),
    ),
    "inventory": (
        ("snapshot_date", "date", False), ("product_id", "text", False),
        ("stock_actual", "integer", False), ("stock_reserved", "integer", False),
        ("stock_available", "integer", False), ("warehouse_location", "text", False),
        ("min_stock", "integer", False), ("max_stock", "integer", False),
    ),
    "purchases": (
        ("purchase_order_id", "text", False), ("order_date", "date", False),
        ("delivery_date", "date", False), ("supplier", "text", False),
        ("product_id", "text", False), ("ordered_quantity", "integer", False),
        ("delivered_quantity", "integer", False), ("purchase_price", "decimal(10,2)", False),
    ),
    "expedition": (
        ("order_id", "text", False), ("received_at", "datetime", False),
        ("picked_at", "datetime", False), ("expedition_date", "date", False),
        ("delivery_type", "text", False), ("vehicle_id", "text", True),
        ("region", "text", False), ("weight_kg", "decimal(12,2)", False),
        ("volume_m3", "decimal(12,3)", False),
    ),
    "vehicles": (
        ("vehicle_id", "text", False), ("capacity_kg", "integer", False),
        ("capacity_m3", "decimal(10,2)", False), ("availability", "text", False),
        ("cost_per_km", "decimal(10,2)", False), ("driver", "text", False),
    ),
}
# What breaks a rule on two values of a row.
ROW_CONDITIONS = {
    "BIZ-E020": "stock_available <> stock_actual - stock_reserved",
    "BIZ-E021": "stock_reserved > stock_actual",
    "BIZ-E022": "min_stock > max_stock",
    "BIZ-E032": "delivered_quantity > ordered_quantity",
    "BIZ-E040": "expedition_date < order_date",
    "BIZ-E041": "delivery_date < order_date",
    "BIZ-E042": "picked_at < received_at",
    "BIZ-E044": "expedition_date < cast(received_at as date)",
    "BIZ-E045": "expedition_date < cast(picked_at as date)",
    "BIZ-E070": f"delivery_type = '{OWN}' and vehicle_id is null",
}
SHEET_KEYS = {
    "products": ("product_id",),
    "vehicles": ("vehicle_id",),
    "inventory": ("snapshot_date", "product_id"),
    "expedition": ("order_id",),
}
# ---------------------------------------------------------------------------------------------

CORE_TABLES = (
    "suppliers", "customers", "products", "vehicles", "sales_orders", "sales_order_lines",
    "purchase_orders", "purchase_order_lines", "inventory_snapshots",
    "inventory_snapshot_lines", "expeditions",
)
MART_TABLES = (
    "sales_monthly", "product_sales_monthly", "inventory_health_monthly",
    "procurement_supplier_monthly", "expedition_monthly", "vehicle_utilization_monthly",
    "management_kpis_monthly",
)

CORE_KEYS = {
    "suppliers": ("supplier_name",),
    "customers": ("customer_id",),
    "products": ("product_id",),
    "vehicles": ("vehicle_id",),
    "sales_orders": ("order_id",),
    "sales_order_lines": ("order_id", "line_number"),
    "purchase_orders": ("purchase_order_id",),
    "purchase_order_lines": ("purchase_order_id", "line_number"),
    "inventory_snapshots": ("snapshot_date",),
    "inventory_snapshot_lines": ("snapshot_id", "product_id"),
    "expeditions": ("order_id",),
}
# child table -> (child columns, parent table, parent columns)
CORE_REFERENCES = (
    ("products", "supplier_id", "suppliers", "id"),
    ("sales_orders", "customer_id", "customers", "customer_id"),
    ("sales_order_lines", "order_id", "sales_orders", "order_id"),
    ("sales_order_lines", "product_id", "products", "product_id"),
    ("purchase_orders", "supplier_id", "suppliers", "id"),
    ("purchase_order_lines", "purchase_order_id", "purchase_orders", "purchase_order_id"),
    ("purchase_order_lines", "product_id", "products", "product_id"),
    ("inventory_snapshot_lines", "snapshot_id", "inventory_snapshots", "id"),
    ("inventory_snapshot_lines", "product_id", "products", "product_id"),
    ("expeditions", "order_id", "sales_orders", "order_id"),
    ("expeditions", "vehicle_id", "vehicles", "vehicle_id"),
)

# Money, percentages and counts are wider than a small installation needs, so that sums over a very large
# core do not overflow; scales and rounding are those of the marts' contract.
MONEY = T.DecimalType(24, 2)
UNIT_PRICE = T.DecimalType(14, 4)
PERCENT = T.DecimalType(18, 4)
DAYS = T.DecimalType(14, 2)
WEIGHT = T.DecimalType(24, 2)
VOLUME = T.DecimalType(24, 3)

# --- fixed values: column types of the marts' contract ----------------------------------------
MART_LIMITS = {
    "decimal(16,2)": (
        "revenue", "estimated_cost", "gross_profit", "inventory_cost_value", "inventory_sales_value",
        "inventory_potential_margin_value", "ordered_value", "delivered_value",
        "procurement_delivered_value", "total_weight_kg", "transported_weight_kg"),
    "decimal(16,3)": ("total_volume_m3", "transported_volume_m3"),
    "decimal(14,2)": ("average_order_value", "average_days_of_cover", "median_days_of_cover"),
    "decimal(14,4)": ("average_unit_price",),
    "decimal(10,2)": (
        "average_actual_lead_time_days", "average_standard_lead_time_days", "average_picking_hours",
        "median_picking_hours", "average_order_to_expedition_days",
        "average_procurement_lead_time_days", "capacity_m3"),
}
MART_BIGINTS = ("units_sold", "ordered_units", "delivered_units", "undelivered_units", "supplier_id")
# ---------------------------------------------------------------------------------------------


def mart_limit(field: T.StructField) -> str | None:
    """Type that the marts' contract gives a column, if values of the column may be beyond it."""
    for declared, columns in MART_LIMITS.items():
        if field.name in columns:
            return declared
    if field.name.endswith("_pct"):
        return "decimal(9,4)"
    return "int" if isinstance(field.dataType, T.LongType) and field.name not in MART_BIGINTS else None


_SPARK_TYPES = {
    "text": T.StringType(), "integer": T.IntegerType(), "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
}


def spark_type(declared: str) -> T.DataType:
    """Contract type name to Spark type."""
    if declared in _SPARK_TYPES:
        return _SPARK_TYPES[declared]
    if declared.startswith("decimal("):
        precision, scale = declared[len("decimal("):-1].split(",")
        return T.DecimalType(int(precision), int(scale))
    raise ValueError(f"unknown contract type {declared!r}")


def sheet_columns(sheet: str) -> list[str]:
    return [name for name, _, _ in SHEETS[sheet]]


def staging_schema(sheet: str) -> T.StructType:
    lineage = [
        T.StructField("import_batch_id", T.StringType(), False),
        T.StructField("source_row_number", T.LongType(), False),
    ]
    return T.StructType(lineage + [
        T.StructField(name, spark_type(declared), nullable)
        for name, declared, nullable in SHEETS[sheet]
    ])


RAW_SCHEMA = T.StructType([
    T.StructField("sheet", T.StringType(), False),
    T.StructField("import_batch_id", T.StringType(), False),
    T.StructField("source_row_number", T.LongType(), False),
    T.StructField("source_data", T.StringType(), False),
    T.StructField("loaded_at", T.TimestampType(), False),
])

ISSUE_SCHEMA = T.StructType([
    T.StructField("severity", T.StringType(), False),
    T.StructField("rule_code", T.StringType(), False),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("source_row_number", T.LongType()),
    T.StructField("business_key", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("actual_value", T.StringType()),
    T.StructField("expected_condition", T.StringType()),
    T.StructField("message", T.StringType()),
])


class _TableSet:
    """Named tables; each is a DataFrame or a function that builds one when first asked for."""

    names: tuple[str, ...] = ()

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        missing = set(self.names) - set(tables)
        if missing:
            raise ValueError(f"missing tables: {sorted(missing)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        value = self._tables[name]
        if not isinstance(value, DataFrame):
            value = self._tables[name] = value()
        return value

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self.names]

    def replace(self, **tables):
        return type(self)(**{**self._tables, **tables})


class Sheets(_TableSet):
    """The six typed input sheets of one batch."""

    names = tuple(SHEETS)


class Core(_TableSet):
    """The eleven normalized tables."""

    names = CORE_TABLES


class Marts(_TableSet):
    """The seven monthly marts."""

    names = MART_TABLES


class State(_TableSet):
    """Facts reduced for the marts; rows of several batches are merged by ``MERGED_BY``."""

    names = (
        "product_days", "customer_months", "product_customers", "price_points", "supplier_totals",
        "shipment_totals", "picking_times", "vehicle_days",
    )


# State table -> key; columns beside it are added up, these but by their maximum.
MERGED_BY = {
    "product_days": ("month_start", "product_id", "order_date"),
    "customer_months": ("month_start", "customer_id"),
    "product_customers": ("month_start", "product_id", "customer_id"),
    "price_points": ("product_id", "price_date"),
    "supplier_totals": ("month_start", "supplier_id"),
    "shipment_totals": ("month_start",),
    "picking_times": ("month_start", "picking"),
    "vehicle_days": ("vehicle_id", "expedition_date"),
}
MERGED_MAXIMA = ("packed", "top_weight", "top_volume")
