"""A small clean batch: every rule holds; one changed cell breaks exactly one of them."""

from datetime import date, datetime
from decimal import Decimal as D

from tidemark.model import SHEETS, Sheets, staging_schema

PRODUCTS = [
    ["P1", "Skrutka", "A", "ks", D("4.00"), D("6.00"), "Dodávateľ A", 5, 10, D("1.500"), D("0.01000")],
    ["P2", "Matica", "B", "bal", D("2.00"), D("3.00"), "Dodávateľ B", 2, 20, D("0.250"), D("0.00200")],
]
SALES = [
    ["S1", date(2024, 1, 1), "P1", 2, D("6.00"), "C1", "Zákazník 1", "BA", "vybavená", date(2024, 1, 3)],
    ["S1", date(2024, 1, 1), "P2", 4, D("3.00"), "C1", "Zákazník 1", "BA", "vybavená", date(2024, 1, 3)],
    ["S2", date(2024, 2, 1), "P1", 1, D("6.50"), "C2", "Zákazník 2", "KE", "vybavená", date(2024, 2, 1)],
    ["S3", date(2024, 4, 10), "P2", 3, D("3.00"), "C1", "Zákazník 1", "ZA", "vybavená", date(2024, 5, 2)],
]
INVENTORY = [
    [date(2024, m, 1), p, 10, 2, 8, "A-1", 5, 50] for m in (1, 2, 3, 4) for p in ("P1", "P2")]
PURCHASES = [
    ["N1", date(2024, 1, 15), date(2024, 1, 20), "Dodávateľ A", "P1", 10, 10, D("5.00")],
    ["N2", date(2024, 1, 20), date(2024, 2, 15), "Dodávateľ A", "P1", 5, 4, D("6.00")],
]
EXPEDITION = [
    ["S1", datetime(2024, 1, 1, 8), datetime(2024, 1, 2, 9, 30), date(2024, 1, 3), "vlastná", "V1", "BA", D("4.00"), D("0.028")],
    ["S2", datetime(2024, 2, 1, 8), datetime(2024, 2, 1, 10), date(2024, 2, 1), "externá", None, "KE", D("1.50"), D("0.010")],
    ["S3", datetime(2024, 4, 11, 8), datetime(2024, 4, 12, 8), date(2024, 5, 2), "osobný odber", None, "ZA", D("0.75"), D("0.006")],
]
VEHICLES = [
    ["V1", 1000, D("10.00"), "pondelok-piatok", D("0.50"), "Ján"],
    ["V2", 500, D("5.00"), "podľa objednávky", D("0.40"), "Eva"],
]
ROWS = {"products": PRODUCTS, "sales": SALES, "inventory": INVENTORY, "purchases": PURCHASES,
        "expedition": EXPEDITION, "vehicles": VEHICLES}


def rows(changes=(), extra=None):
    """The clean rows with cells replaced: (sheet, row index, column, value)."""
    out = {name: [list(r) for r in sheet] for name, sheet in ROWS.items()}
    for sheet, index, column, value in changes:
        position = [c for c, _, _ in SHEETS[sheet]].index(column)
        out[sheet][index][position] = value
    for sheet, row in (extra or []):
        out[sheet].append(list(row))
    return out


def sheets(spark, changes=(), extra=None, batch="b1"):
    data = rows(changes, extra)
    frames = {}
    for name, sheet in data.items():
        schema = staging_schema(name)
        for field in schema.fields:
            field.nullable = True
        frames[name] = spark.createDataFrame(
            [tuple([batch, i + 2, *r]) for i, r in enumerate(sheet)], schema)
    return Sheets(**frames)


def input_sheets(spark, changes=(), extra=None):
    """The same as input: no batch, row number carried."""
    return {n: df.drop("import_batch_id") for n, df in sheets(spark, changes, extra).items()}


NAMED = {"product_id", "order_id", "customer_id", "customer_name", "vehicle_id",
         "purchase_order_id", "supplier"}


def side_by_side(spark, cases):
    """Many cases in one batch: the names of case i start with ``<i>/``, its rows at 1000 i."""
    frames = {}
    for name in ROWS:
        schema = staging_schema(name)
        for field in schema.fields:
            field.nullable = True
        columns = [c for c, _, _ in SHEETS[name]]
        data = []
        for i, (changes, extra) in enumerate(cases):
            for r, row in enumerate(rows(changes, extra)[name]):
                cells = [f"{i}/{v}" if c in NAMED and v is not None else v
                         for c, v in zip(columns, row)]
                data.append(tuple(["b1", i * 1000 + r + 2, *cells]))
        frames[name] = spark.createDataFrame(data, schema)
    return Sheets(**frames)
