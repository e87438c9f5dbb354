"""Repeated keys and inconsistent groups, by aggregation instead of windows over keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_rows(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows after the first of their key, with ``first_row``.

    Nulls form one key.  The first rows come from a map-side combined minimum, and only keys
    that occur more than once are joined back; a key that holds most of the table is an
    ordinary skewed join side.
    """
    firsts = (
        df.groupBy(*keys).agg(F.min(row).alias("first_row"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1).drop("_n")
    )
    firsts = firsts.select("first_row", *[F.col(k).alias(f"_first_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_first_{k}")) for k in keys]
    return (
        df.join(firsts, reduce(Column.__and__, same))
        .where(F.col(row) > F.col("first_row"))
        .drop(*[f"_first_{k}" for k in keys])
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def variants(df: DataFrame, key: str, columns: list[str], row: str) -> DataFrame:
    """Per key: number of distinct column combinations (nulls count) and the first row."""
    return (
        df.groupBy(key, *columns).agg(F.min(row).alias(row))
        .groupBy(key).agg(F.count("*").alias("variant_count"), F.min(row).alias(row))
    )
