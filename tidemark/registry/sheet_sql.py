"""Input sheets derived from the driver's tables, in SQL that both engines read.

Every table row becomes a sheet row.  Keys decide which rows carry which flaw, so each rule
has something to find at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import SHEETS, Sheets, spark_type
from tidemark.sources.landing import numbered_by_position
from tidemark.sources.tables import by_month, table

_REGION = ("case o_custkey % 8 when 0 then 'BA' when 1 then 'BB' when 2 then 'KE' when 3 then "
           "'NR' when 4 then 'PO' when 5 then 'TN' when 6 then 'TT' else 'ZA' end")


def _money(cents: str) -> str:
    return f"cast(cast(cast(floor({cents}) as bigint) as decimal(18,0)) * 0.01 as decimal(10,2))"


_PRICE = "l_extendedprice * 100 / l_quantity"
_SUPPLIER = "'Supplier#' || lpad(cast({} as string), 9, '0')"

# sheet -> (source, filter, column expressions); source columns are those of the tables, with
# ``row_no`` (2 for the first row of the file) and ``suppliers`` (number of suppliers).
SHEET_SQL: dict[str, tuple[str, str, dict[str, str]]] = {
    "products": ("part", "true", {
        "product_id": "case when p_partkey % 73 = 72 then 'P' || (p_partkey - 1) "
                      "else 'P' || p_partkey end",
        "product_name": "p_name",
        "category": "p_type",
        "unit": "case when p_partkey % 47 = 1 then 'krabica' else case p_partkey % 7 "
                "when 0 then 'ks' when 1 then 'bal' when 2 then 'rolka' when 3 then 'vedro' "
                "when 4 then 'sada' when 5 then 'm2' else 'm' end end",
        "purchase_price": f"case when p_partkey % 53 = 1 then {_money('0')} "
                          f"else {_money('p_retailprice * 100')} end",
        "sales_price": f"case when p_partkey % 59 = 1 then {_money('p_retailprice * 90')} "
                       f"else {_money('p_retailprice * 125')} end",
        "supplier": _SUPPLIER.format("p_partkey % suppliers"),
        "minimum_order_quantity": "cast(case when p_partkey % 61 = 1 then 0 "
                                  "else p_partkey % 5 + 1 end as int)",
        "lead_time_days": "cast(case when p_partkey % 67 = 1 then 0 when p_partkey % 71 = 1 "
                          "then -1 else p_size end as int)",
        "weight_kg": "cast(case when p_partkey % 83 = 1 then 0 else p_size * 0.010 end "
                     "as decimal(10,3))",
        "volume_m3": "cast(case when p_partkey % 89 = 1 then 0 else p_size * 0.00003 end "
                     "as decimal(10,5))",
    }),
    "sales": ("lines", "l_returnflag <> 'R'", {
        "order_id": "'SO' || l_orderkey",
        "order_date": "cast(o_orderdate as date)",
        "product_id": "case when l_orderkey % 43 = 1 then 'P1' when l_partkey % 97 = 1 then "
                      "'X' || l_partkey else 'P' || l_partkey end",
        "quantity": "cast(case when l_orderkey % 43 = 1 then 7 when l_partkey % 79 = 1 then 0 when l_partkey % 109 = 1 then -2 "
                    "else l_quantity end as int)",
        "unit_price": f"case when l_orderkey % 43 = 1 then {_money('500')} when l_partkey % 89 = 1 "
                      f"then {_money('0')} when l_partkey % 101 = 1 "
                      f"then {_money('-100')} else {_money(_PRICE)} end",
        "customer_id": "case when o_orderkey % 11 = 3 then 'C0' else 'C' || o_custkey end",
        "customer_name": "case when o_orderkey % 11 = 3 then 'Customer of ' || o_orderkey "
                         "when o_custkey % 40 = 1 then 'Spoločný názov' "
                         "when o_orderkey % 50 = 1 then 'Zákazník ' || o_custkey "
                         "else 'Customer ' || o_custkey end",
        "region": f"case when l_partkey % 83 = 1 then 'XX' else {_REGION} end",
        "order_status": "case when o_orderkey % 61 = 1 then 'nová' when o_orderkey % 13 = 1 "
                        "then 'Vybavená' else 'vybavená' end",
        "expedition_date": "case when o_orderkey % 67 = 1 then cast(o_orderdate as date) - 1 "
                           "else cast(o_orderdate as date) + cast(o_orderkey % 4 as int) end",
    }),
    "purchases": ("lines", "l_returnflag = 'R'", {
        "purchase_order_id": "'PO' || l_orderkey",
        "order_date": "cast(o_orderdate as date)",
        "delivery_date": "case when l_orderkey % 43 = 1 then cast(o_orderdate as date) + 5 "
                         "else cast(l_shipdate as date) end",
        "supplier": "case when l_partkey % 37 = 1 then "
                    + _SUPPLIER.format("l_suppkey") + " else "
                    + _SUPPLIER.format("o_custkey % suppliers") + " end",
        "product_id": "case when l_orderkey % 43 = 1 then 'P1' when l_partkey % 97 = 2 then "
                      "'X' || l_partkey else 'P' || l_partkey end",
        "ordered_quantity": "cast(case when l_orderkey % 43 = 1 then 7 when l_partkey % 79 = 1 "
                            "then 0 else l_quantity end as int)",
        "delivered_quantity": "cast(case when l_orderkey % 43 = 1 then 7 "
                              "when l_partkey % 43 = 1 then l_quantity + 1 "
                              "when l_partkey % 107 = 1 then -1 else floor(l_quantity * 0.9) "
                              "end as int)",
        "purchase_price": f"case when l_orderkey % 43 = 1 then {_money('300')} "
                          f"when l_partkey % 89 = 1 then {_money('0')} "
                          f"else {_money(_PRICE + ' * (1 - l_discount)')} end",
    }),
    "inventory": ("stock", "true", {
        "snapshot_date": "case when month(d) = 7 then d + 1 when year(d) = 1997 and "
                         "month(d) = 5 then d + 45 else d end",
        "product_id": "case when p_partkey % 73 = 72 then 'P' || (p_partkey - 1) "
                      "when p_partkey % 97 = 3 then 'X' || p_partkey "
                      "else 'P' || p_partkey end",
        "stock_actual": "cast(case when p_partkey % 67 = 1 then -1 else (p_partkey * 7 + "
                        "year(d) * 12 + month(d) * 13) % 101 + p_partkey % 7 end as int)",
        "stock_reserved": "cast(case when p_partkey % 59 = 1 then 500 else p_partkey % 7 end "
                          "as int)",
        "stock_available": "cast((p_partkey * 7 + year(d) * 12 + month(d) * 13) % 101 as int)",
        "warehouse_location": "'A-' || (p_partkey % 12)",
        "min_stock": "cast(case when p_partkey % 61 = 1 then 200 else p_partkey % 10 + 5 end "
                     "as int)",
        "max_stock": "cast(p_partkey % 30 + 60 as int)",
    }),
    "expedition": ("orders", "true", {
        "order_id": "case when o_orderkey % 31 = 1 then 'SX' || o_orderkey "
                    "when o_orderkey % 41 = 1 then 'SO' || (o_orderkey - 1) "
                    "else 'SO' || o_orderkey end",
        "received_at": "case when o_orderkey % 71 = 1 then o_orderdate - interval '1' day "
                       "when o_orderkey % 107 = 1 then o_orderdate + interval '5' day "
                       "else o_orderdate + interval '1' minute * cast(o_orderkey % 600 as int) "
                       "end",
        "picked_at": "case when o_orderkey % 73 = 1 then o_orderdate - interval '2' day else "
                     "o_orderdate + interval '1' minute * "
                     "cast(o_orderkey % 600 + 60 + o_orderkey * 7 % 2880 as int) end",
        "expedition_date": "cast(o_orderdate as date) + cast(case when o_orderkey % 79 = 1 "
                           "then 9 else o_orderkey % 4 end as int)",
        "delivery_type": "case when o_orderkey % 83 = 1 then 'dron' else case o_orderkey % 3 "
                         "when 0 then 'vlastná' when 1 then 'externá' else 'osobný odber' end "
                         "end",
        "vehicle_id": "case when o_orderkey % 97 = 1 then 'V1' when o_orderkey % 3 <> 0 or "
                      "o_orderkey % 89 = 1 then null when o_orderkey % 101 = 1 then 'V99' "
                      "else 'V' || cast(floor(o_orderkey / 3) as bigint) % 25 end",
        "region": f"case when o_orderkey % 103 = 1 then 'YY' else {_REGION} end",
        "weight_kg": "cast(cast(cast(floor(o_totalprice) as bigint) % 500000 - 5000 "
                     "as decimal(18,0)) * 0.01 as decimal(12,2))",
        "volume_m3": "cast(cast(cast(floor(o_totalprice) as bigint) % 30000 "
                     "as decimal(18,0)) * 0.001 as decimal(12,3))",
    }),
    "vehicles": ("nation", "true", {
        "vehicle_id": "case when n_nationkey = 24 then 'V23' else 'V' || n_nationkey end",
        "capacity_kg": "cast(case when n_nationkey = 5 then 0 else n_nationkey % 6 * 800 + 800 "
                       "end as int)",
        "capacity_m3": "cast((n_nationkey % 6 + 1) * 5 as decimal(10,2))",
        "availability": "case when n_nationkey = 7 then 'nikdy' when n_nationkey % 2 = 0 then "
                        "'pondelok-piatok' else 'podľa objednávky' end",
        "cost_per_km": "cast((n_nationkey - 9) * 0.05 as decimal(10,2))",
        "driver": "n_name",
    }),
}
_STOCK_ROW = "p_partkey * 1200 + (year(d) - 1992) * 12 + month(d) + 2"


def _sources(spark: SparkSession, directory: str, name: str) -> DataFrame:
    read = lambda t: numbered_by_position(table(spark, directory, t)).withColumnRenamed(
        "source_row_number", "row_no")
    if name == "lines":
        orders = table(spark, directory, "orders").select("o_orderkey", "o_custkey",
                                                          "o_orderdate")
        found = read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    elif name == "stock":
        months = table(spark, directory, "orders").select(F.trunc("o_orderdate", "month").alias("d"))
        found = by_month(table(spark, directory, "part").select("p_partkey"), months).withColumn(
            "row_no", F.expr(_STOCK_ROW))
    else:
        found = read(name)
    if name in ("lines", "part"):
        count = table(spark, directory, "supplier").agg(F.count("*")).scalar()
        found = found.withColumn("suppliers", count)
    return found


def flawed_sheets(spark: SparkSession, directory: str) -> Sheets:
    """The six sheets, typed, over all rows of their tables."""
    def sheet(name: str) -> DataFrame:
        source, condition, columns = SHEET_SQL[name]
        return _sources(spark, directory, source).where(condition).selectExpr(
            "'batch-1' as import_batch_id", "row_no as source_row_number",
            *[f"{text} as {column}" for column, text in columns.items()])

    return Sheets(**{name: (lambda n=name: sheet(n)) for name in SHEETS})


def raw_rows(sheets: Sheets, name: str) -> DataFrame:
    """A sheet as raw JSON rows."""
    from tidemark.sources.landing import land_rows

    return land_rows(getattr(sheets, name).drop("import_batch_id"), name, "batch-1")


def declared_types(name: str):
    return [(column, spark_type(declared)) for column, declared, _ in SHEETS[name]]


# --- the same in DuckDB ---------------------------------------------------------------------------

_DUCK_SOURCES = {
    "part": "(select *, row_number() over () + 1 as row_no, (select count(*) from supplier) "
            "as suppliers from part)",
    "orders": "(select *, row_number() over () + 1 as row_no from orders)",
    "nation": "(select *, row_number() over () + 1 as row_no from nation)",
    "lines": "(select l.*, o.o_orderkey, o.o_custkey, o.o_orderdate, (select count(*) from "
             "supplier) as suppliers from (select *, row_number() over () + 1 as row_no from "
             "lineitem) l join orders o on l_orderkey = o_orderkey)",
    "stock": f"(select p_partkey, d, {_STOCK_ROW} as row_no from part cross join (select "
             "distinct cast(date_trunc('month', o_orderdate) as date) as d from orders))",
}


def sheet_cte(name: str) -> str:
    source, condition, columns = SHEET_SQL[name]
    listed = ", ".join(f"{text} as {column}" for column, text in columns.items())
    return (f"{name} as materialized (select cast(row_no as bigint) as source_row_number, "
            f"{listed} from {_DUCK_SOURCES[source]} where {condition})")


def over_sheets(query: str) -> str:
    """``query`` over the sheets it names."""
    words = set("".join(c if c.isalnum() or c == "_" else " " for c in query).split())
    ctes = [sheet_cte(name) for name in SHEETS if name in words]
    return f"with {', '.join(ctes)}\n{query}"
