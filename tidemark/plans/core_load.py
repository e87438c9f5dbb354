"""Promotion of one batch of staging rows into the core: dimensions upserted, facts appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import Sheets
from tidemark.operators.numbering import dense_ids, number_within


def _lineage(batch: Column) -> list[Column]:
    return [batch.alias("source_import_batch_id")]


def stamped(rows: DataFrame) -> DataFrame:
    """Audit times of a dimension row; an upsert keeps the first ``created_at``."""
    now = F.current_timestamp()
    return rows.withColumn("created_at", now).withColumn("updated_at", now)


def supplier_names(sheets: Sheets) -> DataFrame:
    return (
        sheets.products.select(F.col("supplier").alias("supplier_name"))
        .union(sheets.purchases.select("supplier")).distinct()
    )


def suppliers(sheets: Sheets, existing: DataFrame | None, batch_id: str) -> DataFrame:
    """Suppliers named by products or purchases; known names keep their id."""
    names = supplier_names(sheets)
    batch = F.lit(batch_id)
    if existing is None:
        return dense_ids(names, "supplier_name", F.lit(0)).select("*", *_lineage(batch))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()
    known = names.join(existing.select("id", "supplier_name"), "supplier_name").select(
        "id", "supplier_name")
    unknown = names.join(existing.select("supplier_name"), "supplier_name", "left_anti")
    return known.unionByName(dense_ids(unknown, "supplier_name", top)).select(
        "*", *_lineage(batch))


def customers(sheets: Sheets, batch_id: str) -> DataFrame:
    """The smallest name per customer id."""
    return sheets.sales.groupBy("customer_id").agg(
        F.min("customer_name").alias("customer_name")).select("*", *_lineage(F.lit(batch_id)))


def products(sheets: Sheets, supplier_table: DataFrame) -> DataFrame:
    """Products with the id of their supplier."""
    ids = supplier_table.select(F.col("id").alias("supplier_id"),
                                F.col("supplier_name").alias("supplier"))
    return sheets.products.join(ids, "supplier").select(
        "product_id", "product_name", "category", "unit", "purchase_price", "sales_price",
        "supplier_id", "minimum_order_quantity", "lead_time_days", "weight_kg", "volume_m3",
        F.col("import_batch_id").alias("source_import_batch_id"), "source_row_number")


def vehicles(sheets: Sheets) -> DataFrame:
    """K04."""
    return sheets.vehicles.select(
        "vehicle_id", "capacity_kg", "capacity_m3", "availability", "cost_per_km", "driver",
        F.col("import_batch_id").alias("source_import_batch_id"), "source_row_number")


def sales_orders(sheets: Sheets) -> DataFrame:
    """Distinct order headers."""
    return sheets.sales.select(
        "order_id", "order_date", "customer_id", "region", "order_status", "expedition_date",
        F.col("import_batch_id").alias("source_import_batch_id")).distinct()


def sales_order_lines(sheets: Sheets) -> DataFrame:
    """Lines numbered within their order by sheet row."""
    return number_within(sheets.sales, "order_id", "source_row_number", "line_number").select(
        "order_id", "line_number", "product_id", "quantity", "unit_price",
        F.col("import_batch_id").alias("source_import_batch_id"), "source_row_number")


def purchase_orders(sheets: Sheets, supplier_table: DataFrame) -> DataFrame:
    """Distinct purchase headers with the id of their supplier."""
    ids = supplier_table.select(F.col("id").alias("supplier_id"),
                                F.col("supplier_name").alias("supplier"))
    headers = sheets.purchases.select(
        "purchase_order_id", "order_date", "supplier", "import_batch_id").distinct()
    return headers.join(ids, "supplier").select(
        "purchase_order_id", "order_date", "supplier_id",
        F.col("import_batch_id").alias("source_import_batch_id"))


def purchase_order_lines(sheets: Sheets, batch_seq: int = 0) -> DataFrame:
    """Lines numbered within their order; ``batch_seq`` orders batches for the as-of cost."""
    return number_within(
        sheets.purchases, "purchase_order_id", "source_row_number", "line_number").select(
        "purchase_order_id", "line_number", "delivery_date", "product_id", "ordered_quantity",
        "delivered_quantity", "purchase_price", F.lit(batch_seq).cast("bigint")
        .alias("batch_seq"),
        F.col("import_batch_id").alias("source_import_batch_id"), "source_row_number")


def snapshot_id(day: Column) -> Column:
    """Surrogate of a snapshot: its day number, so lines need no lookup."""
    return F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("bigint")


def inventory_snapshots(sheets: Sheets) -> DataFrame:
    """Distinct snapshot dates."""
    return sheets.inventory.select("snapshot_date", "import_batch_id").distinct().select(
        snapshot_id(F.col("snapshot_date")).alias("id"), "snapshot_date",
        F.col("import_batch_id").alias("source_import_batch_id"))


def inventory_snapshot_lines(sheets: Sheets) -> DataFrame:
    """K10."""
    return sheets.inventory.select(
        snapshot_id(F.col("snapshot_date")).alias("snapshot_id"), "product_id", "stock_actual",
        "stock_reserved", "stock_available", "warehouse_location", "min_stock", "max_stock",
        F.col("import_batch_id").alias("source_import_batch_id"), "source_row_number")


def expeditions(sheets: Sheets) -> DataFrame:
    """K11."""
    return sheets.expedition.select(
        "order_id", "received_at", "picked_at", "expedition_date", "delivery_type",
        "vehicle_id", "region", "weight_kg", "volume_m3",
        F.col("import_batch_id").alias("source_import_batch_id"), "source_row_number")
