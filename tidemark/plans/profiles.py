"""Profiles of the input sheets: counts, ranges, histograms, broken references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import count_true
from tidemark.model import Sheets


def _key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def key_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows of repeated keys (nulls form one key)."""
    return _key_counts(df, keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("key_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def _distinct(df: DataFrame, column: str) -> Column:
    """Number of distinct values, a missing one included, as a scalar."""
    return df.select(column).distinct().agg(F.count("*")).scalar()


def _orphans(child: DataFrame, parent: DataFrame, column: str) -> Column:
    """Number of child rows whose (present or missing) reference the parent does not have."""
    known = parent.select(F.col(column).alias("_known")).distinct()
    rows = child.select(column).join(known, F.col(column).eqNullSafe(F.col("_known")),
                                     "left_anti")
    return rows.agg(F.count("*")).scalar()


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("row_count"))


def products(sheets: Sheets) -> DataFrame:
    """P01."""
    df = sheets.products
    return key_profile(df, ["product_id"]).select(
        F.col("key_count").alias("product_count"),
        F.col("duplicates").alias("product_id_duplicates"),
        _distinct(df, "category").alias("category_count"),
        _distinct(df, "supplier").alias("supplier_count"))


def vehicles(sheets: Sheets) -> DataFrame:
    """P02."""
    return key_profile(sheets.vehicles, ["vehicle_id"]).select(
        F.col("key_count").alias("vehicle_count"),
        F.col("duplicates").alias("vehicle_id_duplicates"))


def sales(sheets: Sheets) -> DataFrame:
    """P03 without its histograms (see ``histogram`` for region and order_status)."""
    df = sheets.sales
    return df.agg(
        F.count("*").alias("line_count"), F.min("order_date").alias("date_min"),
        F.max("order_date").alias("date_max"),
    ).select(
        "*", _distinct(df, "order_id").alias("order_count"),
        _distinct(df, "customer_id").alias("customer_count"),
        _orphans(df, sheets.products, "product_id").alias("product_fk_missing"))


def inventory(sheets: Sheets) -> DataFrame:
    """P04."""
    df = sheets.inventory
    keys = key_profile(df, ["snapshot_date", "product_id"])
    sizes = _key_counts(df, ["snapshot_date"]).agg(F.struct(
        F.count("*").alias("snapshot_count"), F.min("n").alias("rows_per_snapshot_min"),
        F.max("n").alias("rows_per_snapshot_max")))
    return df.agg(
        F.count("*").alias("row_count"), F.min("snapshot_date").alias("date_min"),
        F.max("snapshot_date").alias("date_max"),
        count_true(F.expr("stock_available <> stock_actual - stock_reserved"))
        .alias("equation_errors"),
        count_true(F.expr("stock_reserved > stock_actual")).alias("reserved_over_actual"),
        count_true(F.expr("min_stock > max_stock")).alias("min_over_max"),
    ).select(
        "*", keys.select("duplicates").scalar().alias("key_duplicates"),
        _orphans(df, sheets.products, "product_id").alias("product_fk_missing"),
        sizes.scalar().alias("sizes")).select("*", "sizes.*").drop("sizes")


def purchases(sheets: Sheets) -> DataFrame:
    """P05."""
    df = sheets.purchases
    return df.agg(
        F.count("*").alias("line_count"), F.min("order_date").alias("date_min"),
        F.max("order_date").alias("date_max"),
        count_true(F.expr("delivery_date < order_date")).alias("delivery_before_order"),
        count_true(F.expr("delivered_quantity > ordered_quantity"))
        .alias("delivered_over_ordered"),
    ).select(
        "*", _distinct(df, "purchase_order_id").alias("order_count"),
        _orphans(df, sheets.products, "product_id").alias("product_fk_missing"))


def expedition(sheets: Sheets) -> DataFrame:
    """P06 without its histograms (see ``histogram`` for delivery_type and region)."""
    df = sheets.expedition
    return key_profile(df, ["order_id"]).select(
        "row_count", F.col("duplicates").alias("order_duplicates"),
        _orphans(df, sheets.sales, "order_id").alias("order_fk_missing"),
        _orphans(df.where("vehicle_id is not null"), sheets.vehicles, "vehicle_id")
        .alias("vehicle_fk_missing"),
        df.agg(count_true(F.expr("picked_at < received_at"))).scalar()
        .alias("picked_before_received"))


def summary(sheets: Sheets) -> DataFrame:
    """Counts and date ranges after business validation, one row."""
    def present(df: DataFrame, column: str) -> Column:
        return df.where(F.col(column).isNotNull()).select(column).distinct().agg(
            F.count("*")).scalar()

    dates = sheets.purchases.agg(F.struct(F.min("order_date").alias("purchase_date_min"),
                                          F.max("order_date").alias("purchase_date_max")))
    return sheets.sales.agg(
        F.min("order_date").alias("sales_date_min"), F.max("order_date").alias("sales_date_max"),
    ).select(
        "*", dates.scalar().alias("dates"),
        _distinct(sheets.products, "product_id").alias("product_count"),
        _distinct(sheets.sales, "order_id").alias("sales_order_count"),
        _distinct(sheets.purchases, "purchase_order_id").alias("purchase_order_count"),
        present(sheets.inventory, "snapshot_date").alias("inventory_snapshot_count"),
        _distinct(sheets.expedition, "order_id").alias("expedition_order_count"),
        _distinct(sheets.vehicles, "vehicle_id").alias("vehicle_count"),
    ).select("*", "dates.*").drop("dates")


def preview(sheet: DataFrame, rows: int = 3, columns: int = 20,
            row: str = "source_row_number") -> DataFrame:
    """The first sheet rows (the header is row 1) and at most 20 columns, as text."""
    names = [c for c in sheet.columns if c != row][:columns]
    return sheet.where(F.col(row) <= rows).select(
        row, *[F.col(c).cast("string").alias(c) for c in names])


def dimensions(sheets: dict[str, DataFrame]) -> DataFrame:
    """Rows (header included) and columns per sheet."""
    parts = []
    for name, df in sheets.items():
        width = len([c for c in df.columns if c != "source_row_number"])
        parts.append(df.agg((F.count("*") + 1).alias("max_row")).select(
            F.lit(name).alias("sheet"), "max_row", F.lit(width).alias("max_column")))
    return reduce(DataFrame.unionByName, parts)
