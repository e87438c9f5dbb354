"""Typed staging rows from raw JSON rows, and the completeness check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import SHEETS, Sheets, spark_type


def typed(value: Column, declared: str) -> Column:
    """Strict cast of a raw text value; a value that does not fit raises (ANSI)."""
    if declared == "text":
        return value
    if declared == "date":
        return value.cast("timestamp_ntz").cast("date")
    return value.cast(spark_type(declared))


def tried(value: Column, declared: str) -> Column:
    """The same cast, null where the value does not fit."""
    if declared == "text":
        return value
    if declared == "date":
        return value.try_cast("timestamp_ntz").cast("date")
    return value.try_cast(spark_type(declared))


def _rows(raw: DataFrame, sheet: str, cast) -> DataFrame:
    def cell(name: str, declared: str) -> Column:
        text = F.get_json_object("source_data", f"$.{name}")
        if (sheet, name) == ("expedition", "vehicle_id"):
            text = F.nullif(text, F.lit(""))
        return cast(text, declared).alias(name)

    return raw.where(F.col("sheet") == sheet).select(
        "import_batch_id", "source_row_number",
        *[cell(name, declared) for name, declared, _ in SHEETS[sheet]])


def stage(raw: DataFrame, sheet: str) -> DataFrame:
    """Typed rows of one sheet; the batch filter of ``raw`` prunes partitions."""
    return _rows(raw, sheet, typed)


def stage_leniently(raw: DataFrame, sheet: str) -> DataFrame:
    """Typed rows for checks on input: values that do not parse are null."""
    return _rows(raw, sheet, tried)


def stage_all(raw: DataFrame) -> Sheets:
    return Sheets(**{sheet: (lambda s=sheet: stage(raw, s)) for sheet in SHEETS})


def completeness(raw: DataFrame, sheets: Sheets) -> DataFrame:
    """Rows per sheet in raw and staging, and whether they agree."""
    landed = raw.groupBy("sheet").agg(F.count("*").alias("raw_rows"))
    staged = None
    for name, df in sheets.items():
        counted = df.agg(F.lit(name).alias("sheet"), F.count("*").alias("staging_rows"))
        staged = counted if staged is None else staged.unionByName(counted)
    return staged.join(landed, "sheet", "full_outer").select(
        "sheet", F.coalesce("raw_rows", F.lit(0).cast("bigint")).alias("raw_rows"),
        F.coalesce("staging_rows", F.lit(0).cast("bigint")).alias("staging_rows"),
    ).withColumn("complete", F.col("raw_rows") == F.col("staging_rows"))
