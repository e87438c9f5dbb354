"""As-of price lookup: the last purchase price known on a given day.

The lookup needs one answer per (product, day), however many sales lines share that day.  Both
sides are therefore reduced to one row per product and day *before* anything is ordered:
purchases by the maximum of one packed number, which is a hash aggregate and needs no sorting of
lines, demand by the caller's aggregation.  What is left per product is bounded by the calendar
(two rows a day), so a product that holds a third of all lines makes the window no larger than
any other product's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Places of the packed number, from the right: price in cents (moved up, so that it is positive),
# number of the line, delivery day.  They fill 37 of the 38 digits of a decimal.
_PRICE, _LINE = 11, 19
_PACKED = "decimal(38,0)"


def _whole(power: int) -> Column:
    return F.lit("1" + "0" * power).cast(f"decimal({power + 1},0)")


def line_number_of(lines: DataFrame) -> Column:
    """A line's place in the order of loading: batch, then sheet row; 2^40 rows a batch."""
    row = F.col("source_row_number").cast("bigint")
    return F.shiftleft(F.col("batch_seq").cast("bigint"), 40) + row if "batch_seq" in lines.columns else row


def packed_points(purchase_orders: DataFrame, purchase_order_lines: DataFrame) -> DataFrame:
    """(product_id, price_date, packed): of several lines on a day the latest delivery wins, then the line loaded last.

    ``packed`` may be merged with that of other batches by its maximum.
    """
    day = F.date_diff("delivery_date", F.lit("0001-01-01").cast("date")).cast("decimal(7,0)")
    cents = (F.col("purchase_price") * 100).cast("decimal(11,0)") + _whole(_PRICE - 1)
    packed = (day * _whole(_PRICE + _LINE)
              + F.col("_line").cast("decimal(19,0)") * _whole(_PRICE) + cents).cast(_PACKED)
    lines = purchase_order_lines.select(
        "purchase_order_id", "product_id", "delivery_date", "purchase_price",
        line_number_of(purchase_order_lines).alias("_line")).select(
        "purchase_order_id", "product_id", packed.alias("packed"))
    headers = purchase_orders.select("purchase_order_id",
                                     F.col("order_date").alias("price_date"))
    return (
        lines.join(headers, "purchase_order_id")
        .groupBy("product_id", "price_date").agg(F.max("packed").alias("packed"))
    )


def unpacked(points: DataFrame) -> DataFrame:
    """(product_id, price_date, price) of packed points."""
    cents = (F.col("packed") % _whole(_PRICE)).cast("bigint") - 10 ** (_PRICE - 1)
    price = (cents.cast("decimal(10,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(10,2)")
    return points.select("product_id", "price_date", price.alias("price"))


def price_points(purchase_orders: DataFrame, purchase_order_lines: DataFrame) -> DataFrame:
    """One row per product and purchase day: (product_id, price_date, price)."""
    return unpacked(packed_points(purchase_orders, purchase_order_lines))


def with_price_as_of(demand: DataFrame, points: DataFrame, day: str,
                     output: str = "historical_price", on_day: DataFrame | None = None) -> DataFrame:
    """Add the last price with ``price_date <= day`` (null where the product has none yet).

    ``demand`` must hold at most one row per product and day.  ``on_day`` (product_id, ``day`` and one column,
    one row a product and day) is added where its day is that of the row: it travels with the prices, so that
    the demand is dealt out once.
    """
    payload = [c for c in demand.columns if c not in ("product_id", day)]
    price = points.schema["price"].dataType
    extra = [c for c in on_day.columns if c not in ("product_id", day)] if on_day is not None else []
    asked = demand.select(
        "product_id", F.col(day).alias("_day"), F.lit(1).alias("_side"), F.lit(None).cast(price).alias("_price"),
        F.struct(*payload).alias("_payload"),
    )
    empty = F.lit(None).cast(asked.schema["_payload"].dataType)
    known = points.select(
        "product_id", F.col("price_date").alias("_day"), F.lit(0).alias("_side"),
        F.col("price").alias("_price"), empty.alias("_payload"),
    )
    if extra:
        values = on_day.select(
            "product_id", F.col(day).alias("_day"), F.lit(0).alias("_side"), F.lit(None).cast(price).alias("_price"),
            empty.alias("_payload"), F.struct(F.col(day).alias("at"), F.col(extra[0]).alias("value")).alias("_value"))
        none = F.lit(None).cast(values.schema["_value"].dataType).alias("_value")
        known, asked = known.select("*", none).unionByName(values), asked.select("*", none)
    timeline = (
        Window.partitionBy("product_id").orderBy("_day", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = known.unionByName(asked).withColumn(output, F.last("_price", ignorenulls=True).over(timeline))
    if extra:
        found = found.withColumn("_value", F.last("_value", ignorenulls=True).over(timeline))
    return found.where(F.col("_side") == 1).select(
        *[F.col("_day").alias(c) if c == day else F.col(c) if c == "product_id" else F.col("_payload")[c].alias(c)
          for c in ["product_id", *[c for c in demand.columns if c != "product_id"]]],
        output, *[F.when(F.col("_value.at") == F.col("_day"), F.col("_value.value")).alias(c) for c in extra])
