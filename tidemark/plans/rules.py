"""Business rules on a staged batch: every violation is one issue row.

Rules that look at a row and what it refers to are evaluated together: one scan per sheet, joined to the keys
or order facts it is checked against, one predicate, and issue rows only for the rows it keeps.
Rules on whole orders read the same facts: the rows of an order reduced to one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import (
    AVAILABILITIES, DELIVERY_TYPES, ISSUE_SCHEMA, ORDER_STATUSES, REGIONS, ROW_CONDITIONS, Core,
    Sheets,
)
from tidemark.operators.duplicates import variants
from tidemark.operators.findings import explode_where

KEY = {
    "products": "product_id", "sales": "order_id", "inventory": "product_id",
    "purchases": "purchase_order_id", "expedition": "order_id", "vehicles": "vehicle_id",
}

# --- fixed values: rule catalogue (code, sheet, column, expected condition, message) -------------
CATALOGUE = (
    ("BIZ-E010", "sales", "product_id", "product_id musi existovat v stg.products",
     "Predaj odkazuje na neexistujuci produkt."),
    ("BIZ-E011", "inventory", "product_id", "product_id musi existovat v stg.products",
     "Sklad odkazuje na neexistujuci produkt."),
    ("BIZ-E012", "purchases", "product_id", "product_id musi existovat v stg.products",
     "Nakup odkazuje na neexistujuci produkt."),
    ("BIZ-E013", "expedition", "order_id", "order_id musi existovat v stg.sales",
     "Expedicia odkazuje na neexistujucu objednavku."),
    ("BIZ-E014", "expedition", "vehicle_id", "vyplnene vehicle_id musi existovat v stg.vehicles",
     "Expedicia odkazuje na neexistujuce vozidlo."),
    ("BIZ-E015", "sales", "order_id", "kazda vybavena objednavka musi mat expediciu",
     "Predajna objednavka nema expedicny zaznam."),
    ("BIZ-E020", "inventory", "stock_available", "stock_available = stock_actual - stock_reserved",
     "Skladova rovnica nesedi."),
    ("BIZ-E021", "inventory", "stock_reserved", "stock_reserved <= stock_actual",
     "Rezervovane mnozstvo prevysuje fyzicky sklad."),
    ("BIZ-E022", "inventory", "min_stock", "min_stock <= max_stock",
     "Minimalny sklad prevysuje maximalny sklad."),
    ("BIZ-E023", "inventory", "stock values", "vsetky skladove mnozstva musia byt nezaporne",
     "Sklad obsahuje zapornu hodnotu."),
    ("BIZ-E030", "products", "minimum_order_quantity", "minimum_order_quantity > 0",
     "Minimalne objednavacie mnozstvo musi byt kladne."),
    ("BIZ-E030", "sales", "quantity", "quantity > 0", "Predane mnozstvo musi byt kladne."),
    ("BIZ-E030", "purchases", "ordered_quantity", "ordered_quantity > 0",
     "Objednane mnozstvo musi byt kladne."),
    ("BIZ-E030", "vehicles", "capacity", "capacity_kg > 0 a capacity_m3 > 0",
     "Kapacita vozidla musi byt kladna."),
    ("BIZ-E031", "products", "numeric values",
     "ceny, lead time, hmotnost a objem musia byt nezaporne",
     "Produkt obsahuje zapornu business hodnotu."),
    ("BIZ-E031", "sales", "unit_price", "unit_price >= 0", "Predajna cena je zaporna."),
    ("BIZ-E031", "purchases", "numeric values",
     "delivered_quantity a purchase_price musia byt nezaporne",
     "Nakup obsahuje zapornu business hodnotu."),
    ("BIZ-E031", "expedition", "weight_kg/volume_m3", "hmotnost a objem musia byt nezaporne",
     "Expedicia obsahuje zapornu hmotnost alebo objem."),
    ("BIZ-E031", "vehicles", "cost_per_km", "cost_per_km >= 0",
     "Naklad vozidla na kilometer je zaporny."),
    ("BIZ-E032", "purchases", "delivered_quantity", "delivered_quantity <= ordered_quantity",
     "Dodane mnozstvo prevysuje objednane."),
    ("BIZ-E040", "sales", "expedition_date", "expedition_date >= order_date",
     "Expedicia je pred datumom objednavky."),
    ("BIZ-E041", "purchases", "delivery_date", "delivery_date >= order_date",
     "Dodanie je pred datumom nakupnej objednavky."),
    ("BIZ-E042", "expedition", "picked_at", "picked_at >= received_at",
     "Vychystanie je pred prijatim objednavky."),
    ("BIZ-E043", "expedition", "received_at", "date(received_at) >= sales.order_date",
     "Expedicny proces zacal pred datumom objednavky."),
    ("BIZ-E044", "expedition", "expedition_date", "expedition_date >= date(received_at)",
     "Expedicia je pred prijatim objednavky."),
    ("BIZ-E045", "expedition", "expedition_date", "expedition_date >= date(picked_at)",
     "Expedicia je pred ukoncenim vychystania."),
    ("BIZ-E050", "sales", "order_id", "jedna konzistentna hlavicka na order_id",
     "Predajna objednavka ma nekonzistentnu hlavicku."),
    ("BIZ-E051", "purchases", "purchase_order_id",
     "jedna konzistentna hlavicka na purchase_order_id",
     "Nakupna objednavka ma nekonzistentnu hlavicku."),
    ("BIZ-E060", "sales", "region", "BA, BB, KE, NR, PO, TN, TT alebo ZA",
     "Neplatny region predaja."),
    ("BIZ-E060", "expedition", "region", "BA, BB, KE, NR, PO, TN, TT alebo ZA",
     "Neplatny region expedicie."),
    ("BIZ-E061", "sales", "order_status", "vybavena", "Neplatny stav objednavky."),
    ("BIZ-E062", "expedition", "delivery_type", "vlastna, externa alebo osobny odber",
     "Neplatny typ dopravy."),
    ("BIZ-E063", "vehicles", "availability",
     "pondelok-piatok, pondelok-sobota alebo podla objednavky",
     "Neplatna dostupnost vozidla."),
    ("BIZ-E070", "expedition", "vehicle_id", "pri vlastnej doprave musi byt vehicle_id vyplnene",
     "Vlastna doprava nema priradene vozidlo."),
    ("BIZ-E080", "expedition", "expedition_date", "zhoda so sales.expedition_date",
     "Datum expedicie sa nezhoduje medzi sales a expedition."),
    ("BIZ-E081", "expedition", "region", "zhoda so sales.region",
     "Region sa nezhoduje medzi sales a expedition."),
    ("CORE-E001", "sales", "order_id", "order_id este nesmie existovat v core.sales_orders",
     "Predajna objednavka uz existuje v core."),
    ("CORE-E002", "purchases", "purchase_order_id",
     "purchase_order_id este nesmie existovat v core.purchase_orders",
     "Nakupna objednavka uz existuje v core."),
    ("CORE-E003", "inventory", "snapshot_date",
     "snapshot_date este nesmie existovat v core.inventory_snapshots",
     "Skladovy snapshot uz existuje v core."),
    ("CORE-E004", "expedition", "order_id", "order_id este nesmie existovat v core.expeditions",
     "Expedicia uz existuje v core."),
)
# -------------------------------------------------------------------------------------------------
_TEXTS = {(code, sheet): (column, expected, message)
          for code, sheet, column, expected, message in CATALOGUE}


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _joined(*columns: str) -> str:
    return f"concat_ws(',', {', '.join(f'cast({c} as string)' for c in columns)})"


def _any_negative(*columns: str) -> str:
    return " or ".join(f"{c} < 0" for c in columns)


_STOCKS = ("stock_actual", "stock_reserved", "stock_available", "min_stock", "max_stock")
_PRODUCT_NUMBERS = ("purchase_price", "sales_price", "lead_time_days", "weight_kg", "volume_m3")

# Rules that need nothing but the row: (code, sheet) -> violation, reported value (None: the
# rule's column itself).
ROW_RULES: dict[tuple[str, str], tuple[str, str | None]] = {
    ("BIZ-E020", "inventory"): (ROW_CONDITIONS["BIZ-E020"], None),
    ("BIZ-E021", "inventory"): (ROW_CONDITIONS["BIZ-E021"], None),
    ("BIZ-E022", "inventory"): (ROW_CONDITIONS["BIZ-E022"], None),
    ("BIZ-E023", "inventory"): (_any_negative(*_STOCKS), _joined(*_STOCKS)),
    ("BIZ-E030", "products"): ("minimum_order_quantity <= 0", None),
    ("BIZ-E030", "sales"): ("quantity <= 0", None),
    ("BIZ-E030", "purchases"): ("ordered_quantity <= 0", None),
    ("BIZ-E030", "vehicles"): ("capacity_kg <= 0 or capacity_m3 <= 0",
                               _joined("capacity_kg", "capacity_m3")),
    ("BIZ-E031", "products"): (_any_negative(*_PRODUCT_NUMBERS), _joined(*_PRODUCT_NUMBERS)),
    ("BIZ-E031", "sales"): (_any_negative("unit_price"), None),
    ("BIZ-E031", "purchases"): (_any_negative("delivered_quantity", "purchase_price"),
                                _joined("delivered_quantity", "purchase_price")),
    ("BIZ-E031", "expedition"): (_any_negative("weight_kg", "volume_m3"),
                                 _joined("weight_kg", "volume_m3")),
    ("BIZ-E031", "vehicles"): (_any_negative("cost_per_km"), None),
    ("BIZ-E032", "purchases"): (ROW_CONDITIONS["BIZ-E032"], None),
    ("BIZ-E040", "sales"): (ROW_CONDITIONS["BIZ-E040"], None),
    ("BIZ-E041", "purchases"): (ROW_CONDITIONS["BIZ-E041"], None),
    ("BIZ-E042", "expedition"): (ROW_CONDITIONS["BIZ-E042"], None),
    ("BIZ-E044", "expedition"): (ROW_CONDITIONS["BIZ-E044"], None),
    ("BIZ-E045", "expedition"): (ROW_CONDITIONS["BIZ-E045"], None),
    ("BIZ-E060", "sales"): (f"region not in ({_listed(REGIONS)})", None),
    ("BIZ-E060", "expedition"): (f"region not in ({_listed(REGIONS)})", None),
    ("BIZ-E061", "sales"): (f"lower(order_status) not in ({_listed(ORDER_STATUSES)})", None),
    ("BIZ-E062", "expedition"): (f"delivery_type not in ({_listed(DELIVERY_TYPES)})", None),
    ("BIZ-E063", "vehicles"): (f"availability not in ({_listed(AVAILABILITIES)})", None),
    ("BIZ-E070", "expedition"): (ROW_CONDITIONS["BIZ-E070"], None),
}


def _issue(code: str, sheet: str, key: Column, value: Column) -> Column:
    column, expected, message = _TEXTS[code, sheet]
    return F.struct(
        F.lit("ERROR").alias("severity"), F.lit(code).alias("rule_code"),
        F.lit(sheet).alias("sheet_name"), F.col("source_row_number").cast("bigint")
        .alias("source_row_number"),
        key.cast("string").alias("business_key"), F.lit(column).alias("column_name"),
        value.cast("string").alias("actual_value"), F.lit(expected).alias("expected_condition"),
        F.lit(message).alias("message"))


def _issues(rows: DataFrame, code: str, sheet: str, value: str | Column | None = None,
            key: str | None = None) -> DataFrame:
    value = _TEXTS[code, sheet][0] if value is None else value
    value = F.col(value) if isinstance(value, str) else value
    return rows.select(_issue(code, sheet, F.col(key or KEY[sheet]), value).alias("i")).select(
        *[F.col(f"i.{name}") for name in ISSUE_SCHEMA.names])


# --- facts that rules look up ---------------------------------------------------------------------

SALES_HEADER = ("order_date", "customer_id", "customer_name", "region", "order_status", "expedition_date")


def order_facts(sales: DataFrame) -> DataFrame:
    """One row per order: first sheet row, number of different headers, first order date, least and
    greatest shipping date and region."""
    row = "source_row_number"
    return (
        sales.groupBy("order_id", *SALES_HEADER).agg(F.min(row).alias(row))
        .groupBy("order_id").agg(
            F.min(row).alias(row), F.count("*").alias("variant_count"), F.min("order_date").alias("first_date"),
            F.min("expedition_date").alias("low_date"), F.max("expedition_date").alias("high_date"),
            F.min("region").alias("low_region"), F.max("region").alias("high_region"))
    )


# Rules on a reference: (code, sheet) -> table that must hold the value of the rule's column, if there is one.
REFERENCE_RULES = {
    ("BIZ-E010", "sales"): "products",
    ("BIZ-E011", "inventory"): "products",
    ("BIZ-E012", "purchases"): "products",
    ("BIZ-E014", "expedition"): "vehicles",
}


def _differs(own: str, low: str, high: str) -> str:
    """The order has not exactly one value, or another one than the shipment."""
    return f"({low} is null or {low} <> {high} or {low} <> {own})"


# Rules on a shipment and the facts of its order.
SHIPMENT_RULES = {
    "BIZ-E013": "_order is null",
    "BIZ-E043": "cast(received_at as date) < first_date",
    "BIZ-E080": f"_order and {_differs('expedition_date', 'low_date', 'high_date')}",
    "BIZ-E081": f"_order and {_differs('region', 'low_region', 'high_region')}",
}
# Rules on the facts of an order: condition, reported value.
ORDER_RULES = {
    "BIZ-E015": ("_shipped is null", None),
    "BIZ-E050": ("variant_count > 1", "variant_count"),
    "CORE-E001": ("_loaded", None),
}


def _flagged(rows: DataFrame, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag`` true where ``parent``, one row a key, has their key, else null."""
    return rows.join(parent.select(key, F.lit(True).alias(flag)), key, "left")


def sheet_issues(sheets: Sheets, sheet: str, codes: set[str] | None = None) -> DataFrame | None:
    """All rules on single rows of a sheet, and on what they refer to, in one pass."""
    rows, found = getattr(sheets, sheet), []

    def wanted(code: str) -> bool:
        return codes is None or code in codes

    def add(code: str, condition: str, value: str | None = None) -> None:
        shown = F.expr(value if value is not None else _TEXTS[code, sheet][0])
        found.append((F.expr(condition), _issue(code, sheet, F.col(KEY[sheet]), shown)))

    for (code, of), (violation, value) in ROW_RULES.items():
        if of == sheet and wanted(code):
            add(code, violation, value)
    for (code, of), parent in REFERENCE_RULES.items():
        if of == sheet and wanted(code):
            column, flag = _TEXTS[code, sheet][0], f"_{parent}"
            rows = _flagged(rows, getattr(sheets, parent).select(column).distinct(), column, flag)
            optional = f"{column} is not null and " if code == "BIZ-E014" else ""
            add(code, f"{optional}{flag} is null")
    shipment = [code for code in SHIPMENT_RULES if sheet == "expedition" and wanted(code)]
    if shipment:
        facts = order_facts(sheets.sales).drop("source_row_number", "variant_count")
        rows = rows.join(facts.withColumn("_order", F.lit(True)), "order_id", "left")
        for code in shipment:
            add(code, SHIPMENT_RULES[code])
    return explode_where(rows, found) if found else None


def row_rule_issues(sheets: Sheets, sheet: str) -> DataFrame:
    """The rules that need nothing but the row."""
    return sheet_issues(sheets, sheet, {code for code, of in ROW_RULES if of == sheet})


def order_issues(sheets: Sheets, core: Core | None = None, codes: set[str] | None = None) -> DataFrame:
    """The rules on whole orders in one pass over their facts; CORE-E001 only where there is a core."""
    wanted = [c for c in ORDER_RULES if (codes is None or c in codes) and (c != "CORE-E001" or core is not None)]
    rows = order_facts(sheets.sales)
    if "BIZ-E015" in wanted:
        rows = _flagged(rows, sheets.expedition.select("order_id").distinct(), "order_id", "_shipped")
    if "CORE-E001" in wanted:
        rows = _flagged(rows, core.sales_orders, "order_id", "_loaded")
    found = []
    for code in wanted:
        condition, value = ORDER_RULES[code]
        found.append((F.coalesce(F.expr(condition), F.lit(False)),
                      _issue(code, "sales", F.col("order_id"), F.expr(value or _TEXTS[code, "sales"][0]))))
    return explode_where(rows, found)


def inconsistent_purchase_header(sheets: Sheets) -> DataFrame:
    found = variants(sheets.purchases, "purchase_order_id", ["order_date", "supplier"],
                     "source_row_number")
    return _issues(found.where("variant_count > 1"), "BIZ-E051", "purchases", "variant_count")


def _first_rows(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min("source_row_number").alias("source_row_number"))


def purchase_already_loaded(sheets: Sheets, core: Core) -> DataFrame:
    rows = _first_rows(sheets.purchases, "purchase_order_id").join(
        core.purchase_orders.select("purchase_order_id"), "purchase_order_id", "left_semi")
    return _issues(rows, "CORE-E002", "purchases")


def snapshot_already_loaded(sheets: Sheets, core: Core) -> DataFrame:
    rows = _first_rows(sheets.inventory, "snapshot_date").join(
        core.inventory_snapshots.select("snapshot_date"), "snapshot_date", "left_semi")
    return _issues(rows, "CORE-E003", "inventory", key="snapshot_date")


def expedition_already_loaded(sheets: Sheets, core: Core) -> DataFrame:
    rows = sheets.expedition.join(core.expeditions.select("order_id"), "order_id", "left_semi")
    return _issues(rows, "CORE-E004", "expedition")


CORE_RULES = {
    ("CORE-E002", "purchases"): purchase_already_loaded,
    ("CORE-E003", "inventory"): snapshot_already_loaded,
    ("CORE-E004", "expedition"): expedition_already_loaded,
}


def rule_issues(code: str, sheet: str, sheets: Sheets, core: Core | None = None) -> DataFrame:
    """The issues of one rule on one sheet."""
    if (code, sheet) in CORE_RULES:
        return CORE_RULES[code, sheet](sheets, core)
    if code in ORDER_RULES:
        return order_issues(sheets, core, {code})
    if code == "BIZ-E051":
        return inconsistent_purchase_header(sheets)
    return sheet_issues(sheets, sheet, {code})


def all_issues(sheets: Sheets, core: Core | None) -> DataFrame:
    """Every rule on every sheet; the rules against the core only if there is one."""
    parts = [sheet_issues(sheets, sheet) for sheet in KEY]
    parts += [order_issues(sheets, core), inconsistent_purchase_header(sheets)]
    if core is not None:
        parts += [rule(sheets, core) for rule in CORE_RULES.values()]
    return reduce(DataFrame.unionByName, parts)
