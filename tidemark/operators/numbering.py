"""Row numbers and surrogate ids without gathering a group or a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20


def number_within(df: DataFrame, key: str, order: str, output: str,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``row_number`` per ``key`` by the unique integer column ``order``.

    A key is cut into blocks of consecutive ``order`` values, so no task orders more than
    ``block_rows`` rows of one key.  The size of the earlier blocks is added back.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(key, "_block").agg(F.count("*").alias("_n"))
        .select(key, "_block", F.sum("_n").over(earlier).alias("_offset"))
        .where("_offset is not null")  # keys of a single block have no row here
    )
    position = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order))
    return (
        blocked.withColumn("_position", position).join(offsets, [key, "_block"], "left")
        .withColumn(output, (F.col("_position") + F.coalesce("_offset", F.lit(0))).cast("int"))
        .drop("_block", "_offset", "_position")
    )


def dense_ids(names: DataFrame, name: str, start: Column, output: str = "id") -> DataFrame:
    """Dense ids after ``start`` for distinct ``name`` values.

    Names are spread over 4096 buckets by a hash prefix and numbered inside them; the bucket
    sizes alone are cumulated in one place.  The result depends on the names only, so a
    recomputed task hands out the same ids.
    """
    hashed = names.select(name, F.substring(F.md5(F.col(name)), 1, 3).alias("_bucket"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy(name))
    return hashed.join(offsets, "_bucket").select(
        (start + F.col("_offset") + position).cast("bigint").alias(output), name)
