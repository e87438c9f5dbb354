"""Registered queries: checks on input sheets (field grain, warnings, duplicates)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import SHEETS
from tidemark.plans import contract, sheet_rules
from tidemark.registry.portable import portable
from tidemark.registry.sheet_sql import flawed_sheets, over_sheets
from tidemark.session import configure, written

_KEYS = {"products": "product_id", "sales": "order_id", "purchases": "purchase_order_id",
         "expedition": "order_id", "vehicles": "vehicle_id",
         "inventory": "concat_ws('|', cast(snapshot_date as varchar), product_id)"}


def _finding(level, code, sheet, field, value, expected, rest, key=None, row="source_row_number"):
    return f"""select '{level}' as level, '{code}' as code, '{sheet}' as sheet,
        cast({row} as bigint) as source_row_number,
        cast({key or _KEYS[sheet]} as varchar) as key, '{field}' as field,
        cast({value} as varchar) as value, cast({expected} as varchar) as expected {rest}"""


def _row_sql(level, code, sheet, field, expected, violation):
    return _finding(level, code, sheet, field, field, expected,
                    f"from {sheet} where {violation}")


_UNITS = "'ks', 'bal', 'rolka', 'vedro', 'sada', 'm2', 'm'"
_REGIONS = "'BA', 'BB', 'KE', 'NR', 'PO', 'TN', 'TT', 'ZA'"
_DELIVERY = "'vlastná', 'externá', 'osobný odber'"
_AVAILABLE = "'pondelok-piatok', 'pondelok-sobota', 'podľa objednávky'"


def _words(text: str) -> str:
    return "'" + text.replace("'", "") + "'"


# (level, code, sheet, field, expected, violation) for checks on single rows
_ROWS = [
    *[("ERROR", "BIZ-E030", s, f, "'hodnota > 0'", f"not {f} > 0") for s, f in (
        ("products", "minimum_order_quantity"), ("vehicles", "capacity_kg"),
        ("vehicles", "capacity_m3"), ("sales", "quantity"), ("purchases", "ordered_quantity"))],
    *[("ERROR", "BIZ-E031", s, f, "'hodnota >= 0'", f"not {f} >= 0") for s, f in (
        ("products", "purchase_price"), ("products", "sales_price"),
        ("products", "lead_time_days"), ("products", "weight_kg"), ("products", "volume_m3"),
        ("vehicles", "cost_per_km"), ("sales", "unit_price"),
        ("purchases", "delivered_quantity"), ("purchases", "purchase_price"),
        ("expedition", "weight_kg"), ("expedition", "volume_m3"))],
    *[("ERROR", "BIZ-E023", "inventory", f, "'hodnota >= 0'", f"not {f} >= 0") for f in (
        "stock_actual", "stock_reserved", "stock_available", "min_stock", "max_stock")],
    *[("WARNING", c, s, f, "'nenulova hodnota alebo zdovodnenie'", f"{f} = 0") for s, f, c in (
        ("products", "purchase_price", "BIZ-W002"), ("products", "sales_price", "BIZ-W002"),
        ("products", "weight_kg", "BIZ-W003"), ("products", "volume_m3", "BIZ-W003"),
        ("products", "lead_time_days", "BIZ-W004"), ("vehicles", "cost_per_km", "BIZ-W004"),
        ("sales", "unit_price", "BIZ-W002"), ("purchases", "purchase_price", "BIZ-W002"))],
    ("WARNING", "BIZ-W020", "products", "unit", _words(_UNITS), f"unit not in ({_UNITS})"),
    ("ERROR", "BIZ-E063", "vehicles", "availability", _words(_AVAILABLE),
     f"availability not in ({_AVAILABLE})"),
    ("ERROR", "BIZ-E060", "sales", "region", _words(_REGIONS), f"region not in ({_REGIONS})"),
    ("ERROR", "BIZ-E060", "expedition", "region", _words(_REGIONS),
     f"region not in ({_REGIONS})"),
    ("ERROR", "BIZ-E061", "sales", "order_status", "'vybavená'", "order_status <> 'vybavená'"),
    ("ERROR", "BIZ-E062", "expedition", "delivery_type", _words(_DELIVERY),
     f"delivery_type not in ({_DELIVERY})"),
    ("WARNING", "BIZ-W005", "products", "sales_price", "purchase_price",
     "purchase_price > sales_price"),
    ("ERROR", "BIZ-E040", "sales", "expedition_date", "order_date",
     "order_date > expedition_date"),
    ("ERROR", "BIZ-E020", "inventory", "stock_available", "stock_actual - stock_reserved",
     "stock_actual - stock_reserved <> stock_available"),
    ("ERROR", "BIZ-E021", "inventory", "stock_reserved", "stock_actual",
     "stock_actual < stock_reserved"),
    ("ERROR", "BIZ-E022", "inventory", "min_stock", "max_stock", "max_stock < min_stock"),
    ("WARNING", "BIZ-W013", "inventory", "snapshot_date",
     "cast(date_trunc('month', snapshot_date) as date)", "extract(day from snapshot_date) > 1"),
    ("ERROR", "BIZ-E032", "purchases", "delivered_quantity", "ordered_quantity",
     "ordered_quantity < delivered_quantity"),
    ("ERROR", "BIZ-E041", "purchases", "delivery_date", "order_date",
     "order_date > delivery_date"),
    ("ERROR", "BIZ-E070", "expedition", "vehicle_id", "delivery_type",
     "vehicle_id is null and delivery_type = 'vlastná'"),
    ("WARNING", "BIZ-W015", "expedition", "vehicle_id", "delivery_type",
     "vehicle_id is not null and delivery_type in ('externá', 'osobný odber')"),
    ("ERROR", "BIZ-E042", "expedition", "picked_at", "received_at", "received_at > picked_at"),
    ("ERROR", "BIZ-E044", "expedition", "expedition_date", "cast(received_at as date)",
     "cast(received_at as date) > expedition_date"),
    ("ERROR", "BIZ-E045", "expedition", "expedition_date", "cast(picked_at as date)",
     "cast(picked_at as date) > expedition_date"),
]


def _rows_of(select) -> str:
    return over_sheets(" union all ".join(_row_sql(*r) for r in _ROWS if select(r)))


def _duplicates(sheet: str, code: str, keys: str, field: str, shown: str, key: str) -> str:
    return over_sheets(_finding("ERROR", code, sheet, field, shown, "first_row", f"""from (
        select *, min(source_row_number) over (partition by {keys}) as first_row from {sheet})
        where source_row_number > first_row""", key))


def _unknown(code: str, sheet: str, field: str, parent: str, extra: str = "true") -> str:
    return over_sheets(_finding(
        "ERROR", code, sheet, field, field, f"'existujuci {parent}.{field}'",
        f"from {sheet} where {extra} and {field} not in (select {field} from {parent})"))


_FIRST_SALE = """(select order_id, source_row_number as first_row, order_date, expedition_date,
    region, order_status from sales
    qualify row_number() over (partition by order_id order by source_row_number) = 1)"""
_FIRST_SHIPMENT = """(select order_id, source_row_number, received_at, expedition_date, region,
    weight_kg, volume_m3 from expedition
    qualify row_number() over (partition by order_id order by source_row_number) = 1)"""
_LAST_PRODUCT = """(select * from products
    qualify row_number() over (partition by product_id order by source_row_number desc) = 1)"""
_LAST_VEHICLE = """(select * from vehicles
    qualify row_number() over (partition by vehicle_id order by source_row_number desc) = 1)"""


def _differences(code: str, sheet: str, key: str, columns: tuple[str, ...]) -> str:
    parts = [_finding("ERROR", code, sheet, c, c, "first_value", f"""from (select *,
        first_value({c}) over (partition by {key} order by source_row_number) as first_value
        from {sheet}) where {c} is distinct from first_value""", key) for c in columns]
    return over_sheets(" union all ".join(parts))


def _shipment(code: str, field: str, expected: str, violation: str) -> str:
    return _finding("ERROR", code, "expedition", f"{field}", f"e.{field}", f"s.{expected}",
                    f"from {_FIRST_SALE} s join {_FIRST_SHIPMENT} e using (order_id) "
                    f"where {violation}", "order_id")


def _repeated(code: str, sheet: str, key: str) -> str:
    return over_sheets(_finding(
        "WARNING", code, sheet, "product_id", "product_id",
        "'produkt najviac raz v objednavke alebo business zdovodnenie'",
        f"from (select {key}, product_id from {sheet} group by all having count(*) > 1)", key,
        "null"))


def _several(code: str, key: str, value: str, expected: str) -> str:
    return over_sheets(_finding(
        "WARNING", code, "sales", value, "v", f"'{expected}'", f"""from (select distinct {key}, {value} as v
        from sales where {key} in (select {key} from sales group by {key}
        having count(distinct {value}) > 1))""", key, "null"))


def _loads(code: str, field: str, column: str, places: int) -> str:
    """Half-even rounding by integers: volumes in units of 0.00001, weights of 0.001."""
    unit = {"weight_kg": 1000, "volume_m3": 100000}[field]
    step = unit // 10 ** places
    whole = f"cast(floor(cast(total as double) / {step}) as bigint)"
    rest = f"(cast(total as bigint) - {whole} * {step})"
    even = (f"{whole} + case when {rest} * 2 > {step} or ({rest} * 2 = {step} and "
            f"{whole} % 2 <> 0) then 1 else 0 end")
    return _finding(
        "WARNING", code, "expedition", field, field,
        f"cast(wanted * {'0.' + '0' * (places - 1) + '1'} as decimal(18,{places}))",
        f"""from (select e.*, {even} as wanted from (select order_id,
        sum(quantity * cast({column} * {unit} as bigint)) as total,
        bool_and({column} is not null) as ok from sales left join {_LAST_PRODUCT} p
        using (product_id) group by order_id) join {_FIRST_SHIPMENT} e using (order_id)
        where ok) where cast({field} * {10 ** places} as bigint) <> wanted""", "order_id")


SALES_HEADER = ("order_date", "customer_id", "customer_name", "region", "order_status",
                "expedition_date")

# name -> (Spark plan over the sheets, SQL)
_ENTRIES = {
    "check_e001_duplicate_product": (
        lambda s: sheet_rules.duplicate_keys(s, "products"),
        _duplicates("products", "BIZ-E001", "product_id", "product_id", "product_id",
                    "product_id")),
    "check_e002_duplicate_vehicle": (
        lambda s: sheet_rules.duplicate_keys(s, "vehicles"),
        _duplicates("vehicles", "BIZ-E002", "vehicle_id", "vehicle_id", "vehicle_id",
                    "vehicle_id")),
    "check_e003_duplicate_stock": (
        lambda s: sheet_rules.duplicate_keys(s, "inventory"),
        _duplicates("inventory", "BIZ-E003", "snapshot_date, product_id",
                    "snapshot_date,product_id", _KEYS["inventory"], _KEYS["inventory"])),
    "check_e004_duplicate_expedition": (
        lambda s: sheet_rules.duplicate_keys(s, "expedition"),
        _duplicates("expedition", "BIZ-E004", "order_id", "order_id", "order_id", "order_id")),
    "check_e005_duplicate_sales_row": (
        lambda s: sheet_rules.duplicate_rows(s, "sales"),
        _duplicates("sales", "BIZ-E005", ", ".join(c for c, _, _ in SHEETS["sales"]), "row",
                    "null", "order_id")),
    "check_e006_duplicate_purchase_row": (
        lambda s: sheet_rules.duplicate_rows(s, "purchases"),
        _duplicates("purchases", "BIZ-E006", ", ".join(c for c, _, _ in SHEETS["purchases"]),
                    "row", "null", "purchase_order_id")),
    "check_e010_unknown_sales_product": (
        lambda s: sheet_rules.unknown_product(s, "sales"),
        _unknown("BIZ-E010", "sales", "product_id", "products")),
    "check_e011_unknown_stock_product": (
        lambda s: sheet_rules.unknown_product(s, "inventory"),
        _unknown("BIZ-E011", "inventory", "product_id", "products")),
    "check_e012_unknown_purchase_product": (
        lambda s: sheet_rules.unknown_product(s, "purchases"),
        _unknown("BIZ-E012", "purchases", "product_id", "products")),
    "check_e013_unknown_order": (
        sheet_rules.unknown_order, _unknown("BIZ-E013", "expedition", "order_id", "sales")),
    "check_e014_unknown_vehicle": (
        sheet_rules.unknown_vehicle,
        _unknown("BIZ-E014", "expedition", "vehicle_id", "vehicles",
                 "vehicle_id is not null")),
    "check_e015_fulfilled_without_shipment": (
        sheet_rules.fulfilled_without_shipment,
        over_sheets(_finding(
            "ERROR", "BIZ-E015", "sales", "order_id", "order_id", "'prave jeden expedition riadok'",
            f"from {_FIRST_SALE} where order_status = 'vybavená' and order_id not in "
            "(select order_id from expedition)", "order_id", "first_row"))),
    "check_e043_e080_e081_shipment_differences": (
        sheet_rules.shipment_differences,
        over_sheets(" union all ".join([
            _shipment("BIZ-E043", "received_at", "order_date",
                      "cast(e.received_at as date) < s.order_date"),
            _shipment("BIZ-E080", "expedition_date", "expedition_date",
                      "e.expedition_date is distinct from s.expedition_date"),
            _shipment("BIZ-E081", "region", "region",
                      "e.region is distinct from s.region")]))),
    "check_e050_sales_header_differences": (
        lambda s: sheet_rules.header_differences(s, "sales"),
        _differences("BIZ-E050", "sales", "order_id", SALES_HEADER)),
    "check_e051_purchase_header_differences": (
        lambda s: sheet_rules.header_differences(s, "purchases"),
        _differences("BIZ-E051", "purchases", "purchase_order_id", ("order_date", "supplier"))),
    "check_w006_customer_with_several_names": (
        sheet_rules.customer_with_several_names,
        _several("BIZ-W006", "customer_id", "customer_name", "jeden nazov pre customer_id")),
    "check_w007_name_with_several_customers": (
        sheet_rules.name_with_several_customers,
        _several("BIZ-W007", "customer_name", "customer_id", "jeden customer_id pre nazov")),
    "check_w008_other_supplier": (
        lambda s: sheet_rules.purchase_warnings(s).where("code = 'BIZ-W008'"),
        over_sheets(_finding(
            "WARNING", "BIZ-W008", "purchases", "supplier", "c.supplier", "p.supplier",
            f"from purchases c join {_LAST_PRODUCT} p using (product_id) "
            "where c.supplier <> p.supplier", "purchase_order_id", "c.source_row_number"))),
    "check_w009_not_a_multiple": (
        lambda s: sheet_rules.purchase_warnings(s).where("code = 'BIZ-W009'"),
        over_sheets(_finding(
            "WARNING", "BIZ-W009", "purchases", "ordered_quantity", "ordered_quantity",
            "minimum_order_quantity",
            f"from purchases c join {_LAST_PRODUCT} p using (product_id) where "
            "minimum_order_quantity <> 0 and ordered_quantity % minimum_order_quantity <> 0",
            "purchase_order_id", "c.source_row_number"))),
    "check_w010_repeated_sales_product": (
        lambda s: sheet_rules.repeated_products(s, "sales"),
        _repeated("BIZ-W010", "sales", "order_id")),
    "check_w011_repeated_purchase_product": (
        lambda s: sheet_rules.repeated_products(s, "purchases"),
        _repeated("BIZ-W011", "purchases", "purchase_order_id")),
    "check_w012_incomplete_snapshot": (
        sheet_rules.incomplete_snapshots,
        over_sheets(_finding(
            "WARNING", "BIZ-W012", "inventory", "product_id",
            "'chyba ' || count(*) || ' produktov'", "'vsetky products.product_id'",
            """from (select distinct snapshot_date from inventory) cross join
            (select distinct product_id from products) where (snapshot_date, product_id) not in
            (select (snapshot_date, product_id) from inventory) group by snapshot_date""",
            "snapshot_date", "null"))),
    "check_w014_missing_month": (
        sheet_rules.missing_months,
        over_sheets(_finding(
            "WARNING", "BIZ-W014", "inventory", "snapshot_date", "'chyba'", "'jeden snapshot za mesiac'",
            """from (select cast(unnest(generate_series(date_trunc('month',
            min(snapshot_date)), date_trunc('month', max(snapshot_date)), interval 1 month))
            as date) as m from inventory) where m not in
            (select cast(date_trunc('month', snapshot_date) as date) from inventory)""",
            "strftime(m, '%Y-%m')", "null"))),
    "check_w016_w017_overload": (
        sheet_rules.overload_warnings,
        over_sheets(" union all ".join(_finding(
            "WARNING", code, "expedition", field, field, limit,
            f"from expedition e join {_LAST_VEHICLE} v using (vehicle_id) where "
            f"delivery_type = 'vlastná' and {field} > {limit}", "order_id",
            "e.source_row_number") for code, field, limit in (
                ("BIZ-W016", "weight_kg", "capacity_kg"),
                ("BIZ-W017", "volume_m3", "capacity_m3"))))),
}


def _by_code(code: str):
    sheets = list(dict.fromkeys(r[2] for r in _ROWS if r[1] == code))

    def plan(s) -> DataFrame:
        return reduce(DataFrame.unionByName,
                      [sheet_rules.row_findings(s, sheet, {code}) for sheet in sheets])
    return plan, _rows_of(lambda r: r[1] == code)


for _code, _label in (
        ("BIZ-W002", "w002_zero_price"), ("BIZ-W003", "w003_zero_weight_or_volume"),
        ("BIZ-W004", "w004_zero_lead_time_or_cost"), ("BIZ-W005", "w005_sold_below_cost"),
        ("BIZ-W013", "w013_snapshot_inside_month"), ("BIZ-W015", "w015_unneeded_vehicle"),
        ("BIZ-W020", "w020_unknown_unit"), ("BIZ-E023", "e023_negative_stock"),
        ("BIZ-E030", "e030_not_positive"), ("BIZ-E031", "e031_negative")):
    _ENTRIES[f"check_{_label}"] = _by_code(_code)
for _sheet in ("products", "sales", "inventory", "purchases", "expedition", "vehicles"):
    _ENTRIES[f"check_rows_{_sheet}"] = (
        lambda s, sheet=_sheet: sheet_rules.row_findings(s, sheet),
        _rows_of(lambda r, sheet=_sheet: r[2] == sheet))


def _query(plan):
    def run(spark, directory):
        return portable(plan(flawed_sheets(configure(spark), directory)))
    return run


_ENTRIES["check_w018_w019_load_differences"] = (sheet_rules.load_differences, None)

QUERIES = {name: _query(plan) for name, (plan, _) in _ENTRIES.items()}
ORACLE = {name: sql for name, (_, sql) in _ENTRIES.items() if sql is not None}
ORACLE["check_w018_w019_load_differences"] = over_sheets(
    _loads("BIZ-W018", "weight_kg", "p.weight_kg", 2) + " union all "
    + _loads("BIZ-W019", "volume_m3", "p.volume_m3", 3))


def _rollup(spark, directory):
    """C14 on business findings: count and first 20 examples per code; checks run one after the other."""
    parts = sheet_rules.finding_parts(flawed_sheets(configure(spark), directory))
    example = F.concat_ws("!", "sheet", F.col("source_row_number").cast("string"))
    rolled = contract.stored_rollup(
        parts, ["sheet", F.col("source_row_number").asc_nulls_last(), "key", "field"],
        example, written, contract.BUSINESS_EXAMPLES, sheet_rules.counted_once())
    return portable(rolled.select(
        "level", "code", "issue_count", F.array_join("examples", " ").alias("examples")))


_ALL_CODES = " union all ".join(
    [f"select level, code, sheet, source_row_number, key, field from ({sql})"
     for sql in [ORACLE[n].split("\n", 1)[1] for n in ORACLE
                 if n.startswith("check_rows_") or (not any(
                     n == f"check_{label}" for label in (
                         "w002_zero_price", "w003_zero_weight_or_volume",
                         "w004_zero_lead_time_or_cost", "w005_sold_below_cost",
                         "w013_snapshot_inside_month", "w015_unneeded_vehicle",
                         "w020_unknown_unit", "e023_negative_stock", "e030_not_positive",
                         "e031_negative")))]])
QUERIES["c14_business_rollup"] = _rollup
ORACLE["c14_business_rollup"] = over_sheets(f"""
    select level, code, case when code in ('BIZ-W006', 'BIZ-W007') then max(keys) else max(n) end as issue_count,
           string_agg(concat_ws('!', sheet, cast(source_row_number as varchar)), ' '
                      order by rn) as examples
    from (select *, count(*) over (partition by level, code) as n,
                 count(distinct coalesce(key, '')) over (partition by level, code) as keys,
                 row_number() over (partition by level, code order by sheet,
                   source_row_number nulls last, key, field) as rn
          from ({_ALL_CODES})) where rn <= 20 group by level, code""")
