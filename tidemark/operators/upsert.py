"""Insert-or-update as one join, producing the next version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str],
           keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of both tables; on a common key the incoming values win, except ``keep`` columns."""
    columns = existing.columns
    old = existing.select(*keys, F.struct(*[c for c in columns if c not in keys]).alias("_old"))
    new = incoming.select(*keys, F.struct(*[c for c in columns if c not in keys]).alias("_new"))
    chosen = []
    for column in columns:
        if column in keys:
            chosen.append(F.col(column))
        elif column in keep:
            chosen.append(F.coalesce(f"_old.{column}", f"_new.{column}").alias(column))
        else:
            chosen.append(F.when(F.col("_new").isNotNull(), F.col(f"_new.{column}"))
                          .otherwise(F.col(f"_old.{column}")).alias(column))
    return old.join(new, keys, "full_outer").select(*chosen)
