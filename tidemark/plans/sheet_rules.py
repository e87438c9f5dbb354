"""Business checks on input sheets before anything is loaded.

They differ from the batch rules in grain: fields are reported one by one, the first row of an
order is its reference, and warnings are raised as well.  Sheets come leniently typed: a value
that does not parse is null and takes no part in a comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import (
    AVAILABILITIES, CARRIER, DELIVERY_TYPES, ORDER_STATUSES, OWN, PICKUP, REGIONS, ROW_CONDITIONS, SHEET_KEYS,
    UNITS, Sheets, sheet_columns,
)
from tidemark.operators.duplicates import repeated_rows
from tidemark.operators.findings import explode_where

# What a finding says it expected.
EXPECTED = {
    "positive": "hodnota > 0",
    "not negative": "hodnota >= 0",
    "not zero": "nenulova hodnota alebo zdovodnenie",
    "one name": "jeden nazov pre customer_id",
    "one customer": "jeden customer_id pre nazov",
    "product once": "produkt najviac raz v objednavke alebo business zdovodnenie",
    "known product": "existujuci products.product_id",
    "known order": "existujuci sales.order_id",
    "known vehicle": "existujuci vehicles.vehicle_id",
    "one shipment": "prave jeden expedition riadok",
    "all products": "vsetky products.product_id",
    "one snapshot": "jeden snapshot za mesiac",
}
MISSING_MONTH = "chyba"
MISSING_PRODUCTS = ("chyba ", " produktov")
FIELDS = ("level", "code", "sheet", "source_row_number", "key", "field", "value", "expected")
_ROW = "source_row_number"


def _finding(level: str, code: str, sheet: str, key: Column, field: str, value: Column | None,
             expected: Column | str, row: Column | None = None) -> Column:
    row = F.col(_ROW) if row is None else row
    value = F.lit(None) if value is None else value
    expected = F.lit(expected) if isinstance(expected, str) else expected
    return F.struct(
        F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(sheet).alias("sheet"),
        row.cast("bigint").alias(_ROW), key.cast("string").alias("key"),
        F.lit(field).alias("field"), value.cast("string").alias("value"),
        expected.cast("string").alias("expected"))


def _select(rows: DataFrame, finding: Column) -> DataFrame:
    return rows.select(finding.alias("f")).select(*[F.col(f"f.{name}") for name in FIELDS])


def _inventory_key() -> Column:
    return F.concat_ws("|", F.col("snapshot_date").cast("string"), "product_id")


def _key(sheet: str) -> Column:
    return _inventory_key() if sheet == "inventory" else F.col({
        "products": "product_id", "sales": "order_id", "purchases": "purchase_order_id",
        "expedition": "order_id", "vehicles": "vehicle_id"}[sheet])


# Fields that must be positive and fields that must not be negative, per sheet.
POSITIVE = {
    "products": ("minimum_order_quantity",), "vehicles": ("capacity_kg", "capacity_m3"),
    "sales": ("quantity",), "purchases": ("ordered_quantity",),
}
NOT_NEGATIVE = {
    "products": ("purchase_price", "sales_price", "lead_time_days", "weight_kg", "volume_m3"),
    "vehicles": ("cost_per_km",), "sales": ("unit_price",),
    "purchases": ("delivered_quantity", "purchase_price"),
    "expedition": ("weight_kg", "volume_m3"),
}
STOCKS = ("stock_actual", "stock_reserved", "stock_available", "min_stock", "max_stock")
# Fields whose zero is a warning.
ZERO_WARNINGS = {
    "products": (("purchase_price", "BIZ-W002"), ("sales_price", "BIZ-W002"),
                 ("weight_kg", "BIZ-W003"), ("volume_m3", "BIZ-W003"),
                 ("lead_time_days", "BIZ-W004")),
    "vehicles": (("cost_per_km", "BIZ-W004"),),
    "sales": (("unit_price", "BIZ-W002"),),
    "purchases": (("purchase_price", "BIZ-W002"),),
}
# Vocabularies: (field, level, code, allowed); a missing value is outside.
VOCABULARIES = {
    "products": (("unit", "WARNING", "BIZ-W020", UNITS),),
    "vehicles": (("availability", "ERROR", "BIZ-E063", AVAILABILITIES),),
    "sales": (("region", "ERROR", "BIZ-E060", REGIONS),
              ("order_status", "ERROR", "BIZ-E061", ORDER_STATUSES)),
    "expedition": (("delivery_type", "ERROR", "BIZ-E062", DELIVERY_TYPES),
                   ("region", "ERROR", "BIZ-E060", REGIONS)),
}
# Order between two values: (code, level, violation, field, limit shown).
COMPARISONS = {
    "products": (("BIZ-W005", "WARNING", "sales_price < purchase_price", "sales_price",
                  "purchase_price"),),
    "sales": (("BIZ-E040", "ERROR", ROW_CONDITIONS["BIZ-E040"], "expedition_date",
               "order_date"),),
    "inventory": (
        ("BIZ-E020", "ERROR", ROW_CONDITIONS["BIZ-E020"],
         "stock_available", "stock_actual - stock_reserved"),
        ("BIZ-E021", "ERROR", ROW_CONDITIONS["BIZ-E021"], "stock_reserved", "stock_actual"),
        ("BIZ-E022", "ERROR", ROW_CONDITIONS["BIZ-E022"], "min_stock", "max_stock"),
        ("BIZ-W013", "WARNING", "day(snapshot_date) <> 1", "snapshot_date",
         "trunc(snapshot_date, 'month')")),
    "purchases": (
        ("BIZ-E032", "ERROR", ROW_CONDITIONS["BIZ-E032"], "delivered_quantity",
         "ordered_quantity"),
        ("BIZ-E041", "ERROR", ROW_CONDITIONS["BIZ-E041"], "delivery_date", "order_date")),
    "expedition": (
        ("BIZ-E070", "ERROR", ROW_CONDITIONS["BIZ-E070"], "vehicle_id",
         "delivery_type"),
        ("BIZ-W015", "WARNING",
         f"delivery_type in ('{CARRIER}', '{PICKUP}') and vehicle_id is not null", "vehicle_id",
         "delivery_type"),
        ("BIZ-E042", "ERROR", ROW_CONDITIONS["BIZ-E042"], "picked_at", "received_at"),
        ("BIZ-E044", "ERROR", ROW_CONDITIONS["BIZ-E044"], "expedition_date",
         "cast(received_at as date)"),
        ("BIZ-E045", "ERROR", ROW_CONDITIONS["BIZ-E045"], "expedition_date",
         "cast(picked_at as date)")),
}


def row_conditions(sheet: str, codes: set[str] | None = None) -> list[tuple[Column, Column]]:
    """All checks of one sheet that need nothing but the row: condition and finding."""
    key, found = _key(sheet), []

    def add(code: str, level: str, condition: Column, field: str, expected: Column | str):
        if codes is None or code in codes:
            found.append((condition, _finding(
                level, code, sheet, key, field, F.col(field), expected)))

    for field in POSITIVE.get(sheet, ()):
        add("BIZ-E030", "ERROR", F.col(field) <= 0, field, EXPECTED["positive"])
    for field in NOT_NEGATIVE.get(sheet, ()):
        add("BIZ-E031", "ERROR", F.col(field) < 0, field, EXPECTED["not negative"])
    if sheet == "inventory":
        for field in STOCKS:
            add("BIZ-E023", "ERROR", F.col(field) < 0, field, EXPECTED["not negative"])
    for field, code in ZERO_WARNINGS.get(sheet, ()):
        add(code, "WARNING", F.col(field) == 0, field, EXPECTED["not zero"])
    for field, level, code, allowed in VOCABULARIES.get(sheet, ()):
        inside = F.coalesce(F.col(field).isin(*allowed), F.lit(False))
        add(code, level, ~inside, field, ", ".join(allowed))
    for code, level, violation, field, limit in COMPARISONS.get(sheet, ()):
        add(code, level, F.expr(violation), field, F.expr(limit))
    return found


def row_findings(sheets: Sheets, sheet: str, codes: set[str] | None = None) -> DataFrame:
    """The same in one pass."""
    return explode_where(getattr(sheets, sheet), row_conditions(sheet, codes))


# --- duplicates -----------------------------------------------------------------------------------

DUPLICATE_KEYS = {"products": "BIZ-E001", "vehicles": "BIZ-E002", "inventory": "BIZ-E003",
                  "expedition": "BIZ-E004"}
DUPLICATE_ROWS = {"sales": "BIZ-E005", "purchases": "BIZ-E006"}


def duplicate_keys(sheets: Sheets, sheet: str) -> DataFrame:
    keys = list(SHEET_KEYS[sheet])
    shown = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    rows = repeated_rows(getattr(sheets, sheet).select(_ROW, *keys), keys, _ROW)
    return _select(rows, _finding("ERROR", DUPLICATE_KEYS[sheet], sheet, shown, ",".join(keys),
                                  shown, F.col("first_row")))


def duplicate_rows(sheets: Sheets, sheet: str) -> DataFrame:
    columns = sheet_columns(sheet)
    rows = repeated_rows(getattr(sheets, sheet).select(_ROW, *columns), columns, _ROW)
    return _select(rows, _finding("ERROR", DUPLICATE_ROWS[sheet], sheet, F.col(columns[0]), "row",
                                  None, F.col("first_row")))


# --- references -----------------------------------------------------------------------------------

def _looked_up(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """``child`` beside the row of ``parent`` (one a key) with its reference, a missing value being one too;
    ``_known`` is null where there is none."""
    named = parent.withColumnRenamed(column, "_key").withColumn("_known", F.lit(True))
    return child.join(named, F.col(column).eqNullSafe(F.col("_key")), "left")


_UNKNOWN_PRODUCT = {"sales": "BIZ-E010", "inventory": "BIZ-E011", "purchases": "BIZ-E012"}


def _unknown(code: str, sheet: str, column: str, expected: str) -> tuple[Column, Column]:
    return F.col("_known").isNull(), _finding(
        "ERROR", code, sheet, _key(sheet), column, F.col(column), EXPECTED[expected])


def product_checks(sheets: Sheets, sheet: str) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """BIZ-E010 - E012 unknown product; of purchases W008 other supplier than the product's, W009 not a
    multiple of its minimum."""
    found = [_unknown(_UNKNOWN_PRODUCT[sheet], sheet, "product_id", "known product")]
    if sheet != "purchases":
        return _looked_up(getattr(sheets, sheet), sheets.products.select("product_id").distinct(), "product_id"), found
    catalogue = last_rows(sheets.products, "product_id", ("supplier", "minimum_order_quantity"))
    known, key = F.col("_known") & F.col("product_id").isNotNull(), F.col("purchase_order_id")
    minimum = F.nullif(F.col("own_minimum_order_quantity"), F.lit(0))
    return _looked_up(sheets.purchases, catalogue, "product_id"), [
        *found,
        (known & ~F.col("supplier").eqNullSafe(F.col("own_supplier")),
         _finding("WARNING", "BIZ-W008", "purchases", key, "supplier", F.col("supplier"), F.col("own_supplier"))),
        (known & (F.col("ordered_quantity") % minimum != 0),
         _finding("WARNING", "BIZ-W009", "purchases", key, "ordered_quantity", F.col("ordered_quantity"), minimum))]


def vehicle_checks(sheets: Sheets) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """BIZ-E014 unknown vehicle; W016 / W017 own delivery beyond the weight or volume of its vehicle."""
    fleet = last_rows(sheets.vehicles, "vehicle_id", ("capacity_kg", "capacity_m3"))
    named = F.col("vehicle_id").isNotNull()
    unknown, finding = _unknown("BIZ-E014", "expedition", "vehicle_id", "known vehicle")
    found = [(named & unknown, finding)]
    for code, field, limit in (("BIZ-W016", "weight_kg", "own_capacity_kg"), ("BIZ-W017", "volume_m3", "own_capacity_m3")):
        found.append((named & (F.col("delivery_type") == OWN) & (F.col(field) > F.col(limit)), _finding(
            "WARNING", code, "expedition", F.col("order_id"), field, F.col(field), F.col(limit))))
    return _looked_up(sheets.expedition, fleet, "vehicle_id"), found


def sheet_findings(sheets: Sheets, sheet: str) -> DataFrame:
    """All checks on single rows of a sheet and on what they refer to, in one pass over it."""
    rows, found = getattr(sheets, sheet), []
    if sheet in _UNKNOWN_PRODUCT:
        rows, found = product_checks(sheets, sheet)
    elif sheet == "expedition":
        rows, found = vehicle_checks(sheets)
    return explode_where(rows, row_conditions(sheet) + found)


def unknown_product(sheets: Sheets, sheet: str) -> DataFrame:
    rows, found = product_checks(sheets, sheet)
    return explode_where(rows, found[:1])


def purchase_warnings(sheets: Sheets) -> DataFrame:
    rows, found = product_checks(sheets, "purchases")
    return explode_where(rows, found[1:])


def unknown_vehicle(sheets: Sheets) -> DataFrame:
    rows, found = vehicle_checks(sheets)
    return explode_where(rows, found[:1])


def overload_warnings(sheets: Sheets) -> DataFrame:
    rows, found = vehicle_checks(sheets)
    return explode_where(rows, found[1:])


def unknown_order(sheets: Sheets) -> DataFrame:
    """BIZ-E013."""
    rows = _looked_up(sheets.expedition, sheets.sales.select("order_id").distinct(), "order_id")
    return explode_where(rows, [_unknown("BIZ-E013", "expedition", "order_id", "known order")])


# --- orders ---------------------------------------------------------------------------------------

_SALES_HEADER = ("order_date", "customer_id", "customer_name", "region", "order_status",
                 "expedition_date")
_PURCHASE_HEADER = ("order_date", "supplier")


def first_lines(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The first sheet row per key: (key, first_row, first_<column> ...)."""
    return (
        df.groupBy(key).agg(F.min(F.struct(_ROW, *columns)).alias("s"))
        .select(key, F.col(f"s.{_ROW}").alias("first_row"),
                *[F.col(f"s.{c}").alias(f"first_{c}") for c in columns])
    )


def header_differences(sheets: Sheets, sheet: str) -> DataFrame:
    """BIZ-E050 / E051: one finding per row and field that differs from the order's first row."""
    code, key, columns = {
        "sales": ("BIZ-E050", "order_id", _SALES_HEADER),
        "purchases": ("BIZ-E051", "purchase_order_id", _PURCHASE_HEADER)}[sheet]
    df = getattr(sheets, sheet).select(_ROW, key, *columns)
    joined = df.join(first_lines(df, key, columns), key)
    return explode_where(joined, [
        (~F.col(c).eqNullSafe(F.col(f"first_{c}")),
         _finding("ERROR", code, sheet, F.col(key), c, F.col(c), F.col(f"first_{c}")))
        for c in columns])


def repeated_products(sheets: Sheets, sheet: str) -> DataFrame:
    """BIZ-W010 / W011: a product more than once in an order."""
    code, key = {"sales": ("BIZ-W010", "order_id"),
                 "purchases": ("BIZ-W011", "purchase_order_id")}[sheet]
    pairs = getattr(sheets, sheet).groupBy(key, "product_id").agg(F.count("*").alias("n"))
    return _select(pairs.where("n > 1"), _finding(
        "WARNING", code, sheet, F.col(key), "product_id", F.col("product_id"),
        EXPECTED["product once"], F.lit(None)))


def value_pairs(sheets: Sheets, key: str, value: str) -> DataFrame:
    """Distinct (key, value) pairs of the sales sheet for keys with several values.

    A missing value counts and is shown as None.
    """
    pairs = sheets.sales.select(F.col(key).alias("k"), F.col(value).alias("v")).distinct()
    several = pairs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("k").alias("_k"))
    return pairs.join(several, F.col("k").eqNullSafe(F.col("_k"))).select(
        "k", F.coalesce(F.col("v").cast("string"), F.lit("None")).alias("v"))


# A key with several values is one warning, of which every value is a row.
ONE_PER_KEY = ("BIZ-W006", "BIZ-W007")


def counted_once() -> Column:
    """What rows of findings have in common that count as one; null for all others."""
    return F.when(F.col("code").isin(*ONE_PER_KEY), F.coalesce("key", F.lit("")))


def _several(sheets: Sheets, code: str, key: str, value: str, expected: str) -> DataFrame:
    """One finding per key and value of a key with several values: no list is gathered."""
    return _select(value_pairs(sheets, key, value), _finding(
        "WARNING", code, "sales", F.col("k"), value, F.col("v"), expected, F.lit(None)))


def customer_with_several_names(sheets: Sheets) -> DataFrame:
    return _several(sheets, "BIZ-W006", "customer_id", "customer_name", EXPECTED["one name"])


def name_with_several_customers(sheets: Sheets) -> DataFrame:
    return _several(sheets, "BIZ-W007", "customer_name", "customer_id", EXPECTED["one customer"])


def last_rows(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The last sheet row per key (a repeated key overwrites the earlier one)."""
    return df.groupBy(key).agg(F.max(F.struct(_ROW, *columns)).alias("s")).select(
        key, *[F.col(f"s.{c}").alias(f"own_{c}") for c in columns])


def order_facts(sheets: Sheets) -> DataFrame:
    """One row per order: its first sales row, the weight and volume of its lines as computed from the
    products (``computable`` if every line can be), and its first expedition row, if any (``_shipped``)."""
    loads = last_rows(sheets.products, "product_id", ("weight_kg", "volume_m3"))
    first = ("order_date", "expedition_date", "region", "order_status")
    computable = (F.col("quantity").isNotNull() & F.col("own_weight_kg").isNotNull()
                  & F.col("own_volume_m3").isNotNull())
    orders = sheets.sales.select(_ROW, "order_id", "product_id", "quantity", *first).join(
        loads, "product_id", "left").groupBy("order_id").agg(
        F.min(F.struct(_ROW, *first)).alias("s"), F.every(computable).alias("computable"),
        F.sum(F.col("quantity") * F.col("own_weight_kg")).alias("w"),
        F.sum(F.col("quantity") * F.col("own_volume_m3")).alias("v")).select(
        "order_id", "computable", "w", "v", F.col(f"s.{_ROW}").alias("first_row"),
        *[F.col(f"s.{c}").alias(f"first_{c}") for c in first])
    columns = ("received_at", "expedition_date", "region", "weight_kg", "volume_m3")
    shipments = first_lines(sheets.expedition, "order_id", columns).select(
        F.col("order_id").alias("_order"), F.lit(True).alias("_shipped"), F.col("first_row").alias(_ROW),
        *[F.col(f"first_{c}").alias(c) for c in columns])
    return orders.join(shipments, F.col("order_id").eqNullSafe(F.col("_order")), "left")


def order_conditions() -> dict[str, list[tuple[Column, Column]]]:
    """Checks on ``order_facts``.

    BIZ-E015: the first row says fulfilled, no expedition row exists.  E043, E080, E081: first shipment
    against the first row of its order.  W018 / W019: shipped weight and volume against the sum over the
    order's lines, rounded half to even at 2 and 3 places; an order with a line that cannot be
    computed is left out.
    """
    key = F.col("order_id")
    shipped = F.col("_shipped") & key.isNotNull()

    def differs(code: str, field: str) -> tuple[Column, Column]:
        return shipped & ~F.col(field).eqNullSafe(F.col(f"first_{field}")), _finding(
            "ERROR", code, "expedition", key, field, F.col(field), F.col(f"first_{field}"))

    def load(code: str, field: str, computed: str, places: int) -> tuple[Column, Column]:
        wanted = F.bround(computed, places)
        return shipped & F.col("computable") & (F.bround(field, places) != wanted), _finding(
            "WARNING", code, "expedition", key, field, F.col(field), wanted)

    open_order = F.col("_shipped").isNull() & F.col("first_order_status").isin(*ORDER_STATUSES)
    early = F.col("received_at").cast("date") < F.col("first_order_date")
    return {
        "orders": [(open_order, _finding("ERROR", "BIZ-E015", "sales", key, "order_id", key,
                                         EXPECTED["one shipment"], F.col("first_row")))],
        "shipments": [
            (shipped & early, _finding("ERROR", "BIZ-E043", "expedition", key, "received_at",
                                       F.col("received_at"), F.col("first_order_date"))),
            differs("BIZ-E080", "expedition_date"), differs("BIZ-E081", "region")],
        "loads": [load("BIZ-W018", "weight_kg", "w", 2), load("BIZ-W019", "volume_m3", "v", 3)],
    }


def order_findings(sheets: Sheets) -> DataFrame:
    """All checks on whole orders, in one pass over their facts."""
    return explode_where(order_facts(sheets), [c for conditions in order_conditions().values() for c in conditions])


def fulfilled_without_shipment(sheets: Sheets) -> DataFrame:
    return explode_where(order_facts(sheets), order_conditions()["orders"])


def shipment_differences(sheets: Sheets) -> DataFrame:
    return explode_where(order_facts(sheets), order_conditions()["shipments"])


def load_differences(sheets: Sheets) -> DataFrame:
    return explode_where(order_facts(sheets), order_conditions()["loads"])


# --- snapshots ------------------------------------------------------------------------------------

def incomplete_snapshots(sheets: Sheets) -> DataFrame:
    """BIZ-W012: catalogue products missing per snapshot, by counting what is there."""
    catalogue = sheets.products.select("product_id").distinct()
    size = catalogue.agg(F.count("*")).scalar()
    stocked = sheets.inventory.where("snapshot_date is not null").select(
        "snapshot_date", "product_id").distinct()
    known = catalogue.withColumn("known", F.lit(1))
    found = stocked.join(known, "product_id", "left").groupBy("snapshot_date").agg(
        F.count("known").alias("n"))
    missing = found.select("snapshot_date", (size - F.col("n")).alias("missing"))
    return _select(missing.where("missing > 0"), _finding(
        "WARNING", "BIZ-W012", "inventory", F.col("snapshot_date"), "product_id",
        F.concat(F.lit(MISSING_PRODUCTS[0]), F.col("missing"), F.lit(MISSING_PRODUCTS[1])),
        EXPECTED["all products"], F.lit(None)))


def missing_months(sheets: Sheets) -> DataFrame:
    """BIZ-W014: months without a snapshot between the first and the last one."""
    present = sheets.inventory.where("snapshot_date is not null").select(
        F.trunc("snapshot_date", "month").alias("m")).distinct()
    spine = present.agg(F.min("m").alias("a"), F.max("m").alias("b")).where(
        "a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month")))
                                .alias("m"))
    gaps = spine.join(present, "m", "left_anti")
    return _select(gaps, _finding(
        "WARNING", "BIZ-W014", "inventory", F.date_format("m", "yyyy-MM"), "snapshot_date",
        F.lit(MISSING_MONTH), EXPECTED["one snapshot"], F.lit(None)))


SET_CHECKS = {
    "duplicate_products": lambda s: duplicate_keys(s, "products"),
    "duplicate_vehicles": lambda s: duplicate_keys(s, "vehicles"),
    "duplicate_stock": lambda s: duplicate_keys(s, "inventory"),
    "duplicate_expeditions": lambda s: duplicate_keys(s, "expedition"),
    "duplicate_sales_rows": lambda s: duplicate_rows(s, "sales"),
    "duplicate_purchase_rows": lambda s: duplicate_rows(s, "purchases"),
    "unknown_order": unknown_order,
    "orders": order_findings,
    "sales_header_differences": lambda s: header_differences(s, "sales"),
    "purchase_header_differences": lambda s: header_differences(s, "purchases"),
    "repeated_sales_products": lambda s: repeated_products(s, "sales"),
    "repeated_purchase_products": lambda s: repeated_products(s, "purchases"),
    "customer_with_several_names": customer_with_several_names,
    "name_with_several_customers": name_with_several_customers,
    "incomplete_snapshots": incomplete_snapshots,
    "missing_months": missing_months,
}


def finding_parts(sheets: Sheets) -> list[DataFrame]:
    """The findings of each sheet's rows and of each check on sets."""
    parts = [sheet_findings(sheets, sheet) for sheet in (
        "products", "sales", "inventory", "purchases", "expedition", "vehicles")]
    return parts + [check(sheets) for check in SET_CHECKS.values()]


def all_findings(sheets: Sheets) -> DataFrame:
    return reduce(DataFrame.unionByName, finding_parts(sheets))
