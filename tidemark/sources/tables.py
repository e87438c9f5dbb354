"""Binding of a general trade schema (orders, line items, parts, ...) to the core tables.

The tables carry no fleet, stock or shipment records; those are derived from the rows that
exist, by fixed arithmetic on their keys, so that every core table grows with its source.
Prices arrive as doubles and are brought to whole cents once, here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import month_of
from tidemark.model import AVAILABILITIES, CARRIER, OWN, PICKUP, REGIONS, Core

# Declared so that opening a table reads no file footer.
TABLE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def cents(value: Column) -> Column:
    """Whole cents (a bigint expression) as decimal(10,2)."""
    return (F.floor(value).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")
            ).cast("decimal(10,2)")


def scaled(value: Column, unit: str, target: str) -> Column:
    """Whole units (thousandths and the like) as an exact decimal."""
    places = len(unit.split(".")[1])
    return (value.cast("decimal(18,0)") * F.lit(unit).cast(f"decimal({places},{places})")
            ).cast(target)


def pick(words: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def minutes_after(moment: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), moment)


def by_month(keys: DataFrame, months: DataFrame) -> DataFrame:
    """Each row of ``keys`` with each month ``d`` that occurs in ``months``; a calendar is small, however many rows name it.

    A join, because Spark takes exploded rows for as few as there were before, and so would broadcast them all;
    the keys are dealt out first, because a few bytes of keys make many rows.
    """
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(tasks, *keys.columns).crossJoin(F.broadcast(months.where("d is not null").distinct()))


def core_from_tables(spark: SparkSession, directory: str) -> Core:
    read = lambda name: table(spark, directory, name)
    part, orders, lineitem = read("part"), read("orders"), read("lineitem")
    supplier, nation = read("supplier"), read("nation")
    supplier_count = supplier.agg(F.count("*")).scalar()

    returned = F.col("l_returnflag") == "R"
    day = F.col("o_orderdate").cast("date")
    sold_keys = lineitem.where(~returned).select(F.col("l_orderkey").alias("o_orderkey"))
    bought_keys = lineitem.where(returned).select(F.col("l_orderkey").alias("o_orderkey"))
    sold = orders.join(sold_keys.distinct(), "o_orderkey", "left_semi")
    bought = orders.join(bought_keys.distinct(), "o_orderkey", "left_semi")

    received = minutes_after(F.col("o_orderdate"), F.col("o_orderkey") % 600)
    picked = minutes_after(received, 60 + (F.col("o_orderkey") * 7) % 2880)
    kind = F.col("o_orderkey") % 3
    shipped = F.date_add(picked.cast("date"), (F.col("o_orderkey") % 4 / 2).cast("int"))
    volume_price = F.floor(F.col("o_totalprice"))

    def stock() -> DataFrame:
        return by_month(part.select("p_partkey"), sold.select(month_of(day).alias("d")))

    available = (F.col("p_partkey") * 7 + F.year("d") * 12 + F.month("d") * 13) % 101
    return Core(
        suppliers=lambda: supplier.select(F.col("s_suppkey").alias("id"),
                                  F.col("s_name").alias("supplier_name")),
        customers=lambda: read("customer").select(F.col("c_custkey").alias("customer_id"),
                                          F.col("c_name").alias("customer_name")),
        products=lambda: part.select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"), F.lit("ks").alias("unit"),
            cents(F.col("p_retailprice") * 100).alias("purchase_price"),
            cents(F.col("p_retailprice") * 125).alias("sales_price"),
            (F.col("p_partkey") % supplier_count).alias("supplier_id"),
            (F.col("p_partkey") % 5 + 1).cast("int").alias("minimum_order_quantity"),
            F.col("p_size").alias("lead_time_days"),
            scaled(F.col("p_size") * 10, "0.001", "decimal(10,3)").alias("weight_kg"),
            scaled(F.col("p_size") * 3, "0.00001", "decimal(10,5)").alias("volume_m3"),
        ),
        vehicles=lambda: nation.select(
            F.col("n_nationkey").alias("vehicle_id"),
            ((F.col("n_nationkey") % 6 + 1) * 800).alias("capacity_kg"),
            scaled((F.col("n_nationkey") % 6 + 1) * 500, "0.01", "decimal(10,2)")
            .alias("capacity_m3"),
            F.lit(AVAILABILITIES[0]).alias("availability"),
            scaled(F.col("n_nationkey") + 50, "0.01", "decimal(10,2)").alias("cost_per_km"),
            F.col("n_name").alias("driver"),
        ),
        sales_orders=lambda: sold.select(
            F.col("o_orderkey").alias("order_id"), day.alias("order_date"),
            F.col("o_custkey").alias("customer_id"),
            pick(REGIONS, F.col("o_custkey") % len(REGIONS)).alias("region"),
            F.lit("vybavená").alias("order_status"), shipped.alias("expedition_date"),
        ),
        sales_order_lines=lambda: lineitem.where(~returned).select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            cents(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("unit_price"),
        ),
        purchase_orders=lambda: bought.select(
            F.col("o_orderkey").alias("purchase_order_id"), day.alias("order_date"),
            (F.col("o_custkey") % supplier_count).alias("supplier_id"),
        ),
        purchase_order_lines=lambda: lineitem.where(returned).select(
            F.col("l_orderkey").alias("purchase_order_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_shipdate").cast("date").alias("delivery_date"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("ordered_quantity"),
            F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int"))
            .otherwise(F.floor(F.col("l_quantity") * 0.9).cast("int"))
            .alias("delivered_quantity"),
            cents(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100
                  / F.col("l_quantity")).alias("purchase_price"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("source_row_number"),
        ),
        inventory_snapshots=lambda: sold.select(month_of(day).alias("snapshot_date")).distinct()
        .select(F.date_diff("snapshot_date", F.lit("1970-01-01").cast("date"))
                .cast("bigint").alias("id"), "snapshot_date"),
        inventory_snapshot_lines=lambda: stock().select(
            F.date_diff("d", F.lit("1970-01-01").cast("date")).cast("bigint")
            .alias("snapshot_id"),
            F.col("p_partkey").alias("product_id"),
            (available + F.col("p_partkey") % 7).cast("int").alias("stock_actual"),
            (F.col("p_partkey") % 7).cast("int").alias("stock_reserved"),
            available.cast("int").alias("stock_available"),
            F.concat(F.lit("A-"), F.col("p_partkey") % 12).alias("warehouse_location"),
            (F.col("p_partkey") % 10 + 5).cast("int").alias("min_stock"),
            (F.col("p_partkey") % 30 + 60).cast("int").alias("max_stock"),
        ),
        expeditions=lambda: sold.select(
            F.col("o_orderkey").alias("order_id"), received.alias("received_at"),
            picked.alias("picked_at"), shipped.alias("expedition_date"),
            pick((OWN, CARRIER, PICKUP), kind).alias("delivery_type"),
            F.when(kind == 0, (F.floor(F.col("o_orderkey") / 3) % 25).cast("int"))
            .alias("vehicle_id"),
            pick(REGIONS, F.col("o_custkey") % len(REGIONS)).alias("region"),
            scaled(volume_price % 500000, "0.01", "decimal(12,2)").alias("weight_kg"),
            scaled(volume_price % 30000, "0.001", "decimal(12,3)").alias("volume_m3"),
        ),
    )
