from datetime import date, datetime
from decimal import Decimal as D

from functools import reduce

from fixtures import SALES, sheets, side_by_side
from pyspark.sql import DataFrame

from tidemark.model import SHEETS
from tidemark.plans import rules, sheet_rules

# one broken cell -> the batch rules that must fire, nothing else
BATCH_CASES = [
    ([("sales", 0, "product_id", "P9")], ["BIZ-E010"]),
    ([("inventory", 0, "product_id", "P9")], ["BIZ-E011"]),
    ([("purchases", 0, "product_id", "P9")], ["BIZ-E012"]),
    ([("expedition", 0, "order_id", "S9")], ["BIZ-E013", "BIZ-E015"]),
    ([("expedition", 0, "vehicle_id", "V9")], ["BIZ-E014"]),
    ([("inventory", 0, "stock_available", 7)], ["BIZ-E020"]),
    ([("inventory", 0, "stock_reserved", 12), ("inventory", 0, "stock_available", -2)],
     ["BIZ-E021", "BIZ-E023"]),
    ([("inventory", 0, "min_stock", 60)], ["BIZ-E022"]),
    ([("products", 0, "minimum_order_quantity", 0)], ["BIZ-E030"]),
    ([("sales", 0, "quantity", 0)], ["BIZ-E030"]),
    ([("purchases", 0, "ordered_quantity", 0), ("purchases", 0, "delivered_quantity", 0)],
     ["BIZ-E030"]),
    ([("vehicles", 0, "capacity_m3", D("0.00"))], ["BIZ-E030"]),
    ([("products", 0, "sales_price", D("-1.00"))], ["BIZ-E031"]),
    ([("sales", 0, "unit_price", D("-1.00"))], ["BIZ-E031"]),
    ([("purchases", 0, "purchase_price", D("-1.00"))], ["BIZ-E031"]),
    ([("expedition", 0, "weight_kg", D("-1.00"))], ["BIZ-E031"]),
    ([("vehicles", 0, "cost_per_km", D("-0.10"))], ["BIZ-E031"]),
    ([("purchases", 0, "delivered_quantity", 11)], ["BIZ-E032"]),
    ([("sales", 2, "expedition_date", date(2024, 1, 31)),
      ("expedition", 1, "expedition_date", date(2024, 1, 31))],
     ["BIZ-E040", "BIZ-E044", "BIZ-E045"]),
    ([("purchases", 0, "delivery_date", date(2024, 1, 14))], ["BIZ-E041"]),
    ([("expedition", 0, "picked_at", datetime(2024, 1, 1, 7))], ["BIZ-E042"]),
    ([("expedition", 2, "received_at", datetime(2024, 4, 9, 7))], ["BIZ-E043"]),
    ([("sales", 1, "customer_name", "iný")], ["BIZ-E050"]),
    ([("sales", 1, "region", "BB")], ["BIZ-E050", "BIZ-E081"]),
    ([("purchases", 1, "purchase_order_id", "N1")], ["BIZ-E051"]),
    ([("sales", 2, "region", "XX"), ("expedition", 1, "region", "XX")],
     ["BIZ-E060", "BIZ-E060"]),
    ([("sales", 2, "order_status", "nová")], ["BIZ-E061"]),
    ([("sales", 2, "order_status", "VYBAVENÁ")], []),
    ([("expedition", 1, "delivery_type", "dron")], ["BIZ-E062"]),
    ([("vehicles", 1, "availability", "nikdy")], ["BIZ-E063"]),
    ([("expedition", 0, "vehicle_id", None)], ["BIZ-E070"]),
    ([("expedition", 0, "expedition_date", date(2024, 1, 4))], ["BIZ-E080"]),
    ([("expedition", 0, "region", "BB")], ["BIZ-E081"]),
    ([], []),
]


def test_each_broken_cell_fires_its_rules_only(spark):
    cases = [(changes, None) for changes, _ in BATCH_CASES]
    found: dict[int, list] = {i: [] for i in range(len(cases))}
    for row in rules.all_issues(side_by_side(spark, cases), None).collect():
        assert row.severity == "ERROR"
        assert row.source_row_number // 1000 == int(row.business_key.split("/")[0])
        found[row.source_row_number // 1000].append(row.rule_code)
    for i, (changes, codes) in enumerate(BATCH_CASES):
        assert sorted(found[i]) == codes, changes


SHEET_CASES = [
    ([], [], []),
    ([("products", 1, "product_id", "P1")], [], ["BIZ-E001", "BIZ-E010", "BIZ-E011"]),
    ([("vehicles", 1, "vehicle_id", "V1")], [], ["BIZ-E002"]),
    ([("inventory", 1, "product_id", "P1")], [], ["BIZ-E003"]),
    ([], [("sales", SALES[2])], ["BIZ-E005"]),
    ([("sales", 2, "order_status", "VYBAVENÁ")], [], ["BIZ-E061"]),
    ([("products", 0, "sales_price", D("3.00"))], [], ["BIZ-W005"]),
    ([("products", 0, "sales_price", D("0.00"))], [], ["BIZ-W002", "BIZ-W005"]),
    ([("products", 0, "lead_time_days", 0)], [], ["BIZ-W004"]),
    ([("products", 0, "unit", None)], [], ["BIZ-W020"]),
    ([("sales", 3, "customer_name", None)], [], ["BIZ-W006"]),
    ([("sales", 2, "customer_name", "Zákazník 1")], [], ["BIZ-W007"]),
    ([("purchases", 0, "supplier", "Dodávateľ B")], [], ["BIZ-W008"]),
    ([("purchases", 0, "ordered_quantity", 12)], [], ["BIZ-W009"]),
    ([("sales", 1, "product_id", "P1")], [], ["BIZ-W010"]),
    ([("inventory", 0, "snapshot_date", date(2024, 1, 2))], [], ["BIZ-W013"]),
    ([("expedition", 1, "vehicle_id", "V2")], [], ["BIZ-W015"]),
    ([("vehicles", 0, "capacity_kg", 3)], [], ["BIZ-W016"]),
    ([("vehicles", 0, "capacity_m3", D("0.02"))], [], ["BIZ-W017"]),
    ([("expedition", 0, "weight_kg", D("4.01"))], [], ["BIZ-W018"]),
    ([("expedition", 0, "volume_m3", D("0.029"))], [], ["BIZ-W019"]),
    ([("products", 1, "volume_m3", None)], [], []),
]


# checks that look at the whole catalogue or calendar, tested apart
WHOLE = {"incomplete_snapshots", "missing_months"}
# what a changed product or line may bring along
FOLLOW_UPS = {"BIZ-W008", "BIZ-W009", "BIZ-W010", "BIZ-W018", "BIZ-W019"}


def test_each_broken_cell_is_found_on_the_sheet(spark):
    s = side_by_side(spark, [(changes, extra) for changes, extra, _ in SHEET_CASES])
    parts = [sheet_rules.sheet_findings(s, sheet) for sheet in SHEETS]
    parts += [check(s) for name, check in sheet_rules.SET_CHECKS.items() if name not in WHOLE]
    found: dict[int, set] = {i: set() for i in range(len(SHEET_CASES))}
    for row in reduce(DataFrame.unionByName, parts).collect():
        case = row.key.split("|")[-1].split("/")[0]
        found[int(case)].add(row.code)
    for i, (changes, _, codes) in enumerate(SHEET_CASES):
        assert set(codes) <= found[i] and found[i] - set(codes) <= FOLLOW_UPS, (changes, found[i])


def test_clean_sheets_have_no_findings(spark):
    assert sheet_rules.all_findings(sheets(spark)).collect() == []


def test_incomplete_snapshot(spark):
    moved = [("inventory", 0, "snapshot_date", date(2024, 5, 1))]
    found = sheet_rules.incomplete_snapshots(sheets(spark, moved)).collect()
    assert sorted((r.key, r.value) for r in found) == [
        ("2024-01-01", "chyba 1 produktov"), ("2024-05-01", "chyba 1 produktov")]


def test_missing_month_and_half_even_rounding(spark):
    gap = [("inventory", i, "snapshot_date", date(2024, 6, 1)) for i in (6, 7)]
    found = sheet_rules.missing_months(sheets(spark, gap)).collect()
    assert sorted(r.key for r in found) == ["2024-04", "2024-05"]
    # 0.125 and 0.135 kg round to 0.12 and 0.14 kg
    for grams, shipped in (("0.125", "0.12"), ("0.135", "0.14")):
        changes = [("products", 0, "weight_kg", D(grams)), ("expedition", 1, "weight_kg", D(shipped))]
        codes = [r.key for r in sheet_rules.load_differences(sheets(spark, changes)).collect()
                 if r.code == "BIZ-W018"]
        assert "S2" not in codes


def test_every_value_of_a_key_is_reported(spark):
    changes = [("sales", i, "customer_id", "C1") for i in range(4)]
    changes += [("sales", i, "customer_name", f"n{i}") for i in range(4)]
    found = sheet_rules.customer_with_several_names(sheets(spark, changes)).collect()
    assert sorted((r.key, r.value) for r in found) == [("C1", f"n{i}") for i in range(4)]


def scans(df):
    """Reads of a table in the executed plan, those of reused exchanges left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Scan" in line for line in plan.split("\n"))


def test_rules_share_their_inputs(spark, tmp_path):
    s = sheets(spark)
    for name, df in s.items():
        df.write.parquet(str(tmp_path / name))
    stored = type(s)(**{name: spark.read.parquet(str(tmp_path / name)) for name, _ in s.items()})
    assert scans(rules.all_issues(stored, None)) <= 14
    assert scans(sheet_rules.all_findings(stored)) <= 40


def test_a_key_with_several_values_is_one_warning(spark):
    from tidemark.plans import contract

    changes = [("sales", i, "customer_id", "C1") for i in range(4)]
    changes += [("sales", i, "customer_name", f"n{i}") for i in range(4)]
    found = sheet_rules.all_findings(sheets(spark, changes))
    counts = {r.code: r.issue_count for r in contract.counted_issues(found, sheet_rules.counted_once()).collect()}
    assert counts["BIZ-W006"] == 1 and found.where("code = 'BIZ-W006'").count() == 4


def test_values_beyond_the_declared_types(spark):
    from tidemark.plans import audit

    rows = [("m1", D("99999999999999.99"), D("99999.9999"), 2 ** 31 - 1, 2 ** 40), ("m2", D("100000000000000.00"), D("100000.0000"), 2 ** 31, 2 ** 40),
            ("m3", D("-100000000000000.00"), None, -2 ** 31, 1), ("m4", None, D("-100000.0000"), None, None)]
    mart = spark.createDataFrame(rows, "month_start string, revenue decimal(24,2), gross_margin_pct decimal(18,4), order_count long, units_sold long")
    got = sorted((r.key, r.column_name, r.declared) for r in audit.overflow_violations(mart, "m", ["month_start"]).collect())
    assert got == [("m2", "gross_margin_pct", "decimal(9,4)"), ("m2", "order_count", "int"), ("m2", "revenue", "decimal(16,2)"),
                   ("m3", "revenue", "decimal(16,2)"), ("m4", "gross_margin_pct", "decimal(9,4)")]
