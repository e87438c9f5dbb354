"""Several conditions on a row, one output row per condition that holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_where(rows: DataFrame, findings: list[tuple[Column, Column]]) -> DataFrame:
    """The struct of every (condition, struct) pair whose condition holds, as columns.

    Rows without any are filtered out first, by one generated predicate: on mostly clean data
    nothing is built for a row.  They are built before the explosion, which would interpret them.
    """
    some = reduce(Column.__or__, [condition for condition, _ in findings])
    found = F.array(*[F.when(condition, record) for condition, record in findings])
    return (
        rows.where(some).select(found.alias("_all")).select(F.explode("_all").alias("_f"))
        .where(F.col("_f").isNotNull()).select("_f.*")
    )
