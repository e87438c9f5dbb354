"""Exact grouped median without gathering a group.

An exact percentile aggregate keeps every distinct value of a group in one buffer.  Here each
group is first reduced to (value, count) pairs, then to counts per logarithmic bin.  The bins say
which one or two of them hold the middle ranks; only the values of those bins are ordered.
The number of bins is bounded by the value range (4096 per factor e), and a bin holds at
most its width divided by the value's resolution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BINS_PER_E = 4096


def grouped_median(df: DataFrame, keys: list[str], value: str, output: str = "median",
                   weight: str | None = None) -> DataFrame:
    """Median of the non-null values per group: the mean of the two middle values.

    ``value`` must be an integer or a decimal; with ``weight`` a row stands for so many equal ones.
    """
    times = F.count("*") if weight is None else F.sum(weight)
    number = F.col("_v").cast("double")
    log_bin = F.signum(number) * F.floor(F.ln(F.abs(number) + 1.0) * _BINS_PER_E)
    pairs = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v")).agg(times.alias("_n"))
        .withColumn("_bin", log_bin.cast("long"))
    )

    whole = Window.partitionBy(*keys)
    upward = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        pairs.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(upward))
        .withColumn("_total", F.sum("_bn").over(whole))
        .withColumn("_lo", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2))
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
        .where(_covers("_lo", "_before", "_upto") | _covers("_hi", "_before", "_upto"))
        .select(*keys, "_bin", "_before", "_lo", "_hi")
    )
    within = (
        Window.partitionBy(*keys, "_bin").orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        pairs.join(bins, [*keys, "_bin"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(within))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    middle = F.when(_covers("_lo", "_start", "_end"), F.col("_v"))
    upper = F.when(_covers("_hi", "_start", "_end"), F.col("_v"))
    return (
        ranked.groupBy(*keys)
        .agg(F.max(middle).alias("_a"), F.max(upper).alias("_b"))
        .select(*keys, ((F.col("_a") + F.col("_b")).cast("decimal(30,10)")
                        / F.lit(2)).cast("decimal(30,10)").alias(output))
    )


def _covers(rank: str, start: str, end: str):
    return (F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(end))
