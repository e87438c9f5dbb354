from datetime import date
from decimal import Decimal as D

import pytest

from tidemark.model import MART_TABLES, Marts, Sheets
from tidemark.plans import contract, serve, sheet_rules, staging, views
from tidemark.plans.contract import ContractColumn
from tidemark.sources import landing


@pytest.fixture(scope="module")
def marts(spark):
    kpi = ", ".join(f"{k} double" for k in serve.COMPARED_KPIS)
    months = [(date(2024, 1, 1), 100.0), (date(2024, 2, 1), 0.0), (date(2024, 3, 1), 150.0),
              (date(2025, 2, 1), 50.0), (date(2025, 3, 1), 75.0), (date(2025, 4, 1), None)]
    management = spark.createDataFrame(
        [(m, *[v] * len(serve.COMPARED_KPIS)) for m, v in months], f"month_start date, {kpi}")
    products = spark.createDataFrame(
        [(date(2024, 1, 1), p, p, c, s, 1, 1, 1, D(r), D("1.00"), D(r) - 1)
         for p, c, s, r in (("b", "x", "S2", "0.00"), ("a", "x", "S1", "4.00"),
                            ("c", "y", "S1", "2.00"), ("d", "y", "S1", "2.00"))],
        "month_start date, product_id string, product_name string, category string, "
        "supplier_name string, units_sold bigint, order_count bigint, customer_count bigint, "
        "revenue decimal(24,2), estimated_cost decimal(24,2), gross_profit decimal(24,2)")
    empty = management.limit(0)
    return Marts(**{**{n: empty for n in MART_TABLES}, "management_kpis_monthly": management,
                    "product_sales_monthly": products})


def test_ranking_puts_unknown_margin_first_and_breaks_ties(marts):
    def ids(**kw):
        return [r.product_id for r in serve.product_ranking(marts, **kw).collect()]
    assert ids(sort_by="gross_margin_pct") == ["b", "a", "c", "d"]
    assert ids(sort_by="gross_margin_pct", direction="asc") == ["c", "d", "a", "b"]
    assert ids(sort_by="revenue", limit=2) == ["a", "c"]
    assert ids(category="y", supplier="S1") == ["c", "d"]
    for wrong in ({"sort_by": "name"}, {"direction": "up"}, {"limit": 0}, {"limit": 101}):
        with pytest.raises(ValueError):
            serve.product_ranking(marts, **wrong)


def test_ranges(marts):
    assert serve.resolve_range(marts, "management_kpis_monthly", date(2024, 2, 20)) == (
        date(2024, 2, 1), date(2025, 4, 1))
    with pytest.raises(ValueError):
        serve.resolve_range(marts, "management_kpis_monthly", date(2026, 1, 1))
    with pytest.raises(ValueError):
        serve.resolve_range(marts, "sales_monthly")
    with pytest.raises(serve.MartEmpty):
        serve.inventory(marts)


def test_filter_options_are_null_without_rows(marts):
    row = serve.filter_options(marts).first()
    assert row.categories == ["x", "y"] and row.suppliers == ["S1", "S2"]
    none = serve.filter_options(marts, date(2024, 1, 1), date(2024, 1, 1))
    assert none.where("categories is null").count() == 0
    gone = marts.replace(product_sales_monthly=marts.product_sales_monthly)
    row = serve.filter_options(gone, date(2020, 1, 1), date(2020, 2, 1)).first()
    assert row.categories is None and row.suppliers is None


def test_summary_uses_calendar_offsets(marts):
    row = serve.summary(marts).first()
    assert row.selected_month == date(2025, 3, 1)
    assert row.month_over_month_pct.revenue == 50.0 and row.year_over_year_pct.revenue == -50.0
    row = serve.summary(marts, date(2024, 3, 9)).first()
    assert row.month_over_month_pct.revenue is None     # previous value is zero
    assert row.previous_year is None and row.year_over_year_pct.revenue is None
    with pytest.raises(serve.NotAvailable):
        serve.summary(marts, date(2024, 7, 1))


def test_views(marts):
    long = views.series(marts.management_kpis_monthly, {"revenue": "Tržby"}).collect()
    assert len(long) == 5 and {r.series for r in long} == {"Tržby"}
    table = views.report_table(marts.management_kpis_monthly, {"month_start": "Mesiac"},
                               "month_start").first()
    assert table.Mesiac == "01/2024"
    assert views.sales_month_choices(marts, date(2025, 1, 1)).count() == 2


def test_rows_keep_their_place_in_many_splits(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("a,b\n" + "".join(f"x{i},{i}\n" for i in range(2, 3000)), "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = landing.read_sheet(spark, str(path), "csv", "a string, b int")
        assert df.where("b <> source_row_number").count() == 0 and df.count() == 2998
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parquet = str(tmp_path / "p")
    df.repartitionByRange(5, "b").sortWithinPartitions("b").select("a", "b").write.parquet(parquet)
    again = landing.read_sheet(spark, parquet, "parquet")
    assert again.where("b <> source_row_number").count() == 0


def test_landing_and_typing(spark):
    sheet = spark.createDataFrame(
        [(2, "V1", 5, D("1.50"), None, D("0.10"), "J"), (3, None, None, None, None, None, None),
         (4, "V2", 6, D("2.00"), "x", D("0.20"), "E")],
        "source_row_number bigint, vehicle_id string, capacity_kg int, capacity_m3 decimal(10,2),"
        " availability string, cost_per_km decimal(10,2), driver string")
    raw = landing.land_rows(sheet, "vehicles", "b")
    rows = {r.source_row_number: r.source_data for r in raw.collect()}
    assert sorted(rows) == [2, 4] and '"availability":null' in rows[2]
    assert '"capacity_m3":"1.50"' in rows[2]
    typed = staging.stage(raw, "vehicles").where("source_row_number = 2").first()
    assert typed.capacity_m3 == D("1.50") and typed.capacity_kg == 5
    text = raw.selectExpr("sheet", "import_batch_id", "source_row_number",
                          "replace(source_data, ':5,', ':\"5.0\",') as source_data", "loaded_at")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        staging.stage(text, "vehicles").collect()
    lenient = staging.stage_leniently(text, "vehicles").where("source_row_number = 2").first()
    assert lenient.capacity_kg is None
    for header in (["a", ""], ["a", None], ["a", "a"], []):
        with pytest.raises(landing.BadHeader):
            landing.guard_header("s", header)


def test_fingerprints_and_new_files(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "one"), ("c", "two")):
        (tmp_path / f"{name}.csv").write_text(text)
    files = landing.fingerprints(spark, str(tmp_path))
    known = files.where("path like '%c.csv'").select("file_sha256")
    fresh = landing.new_files(files, known).collect()
    assert [r.path.rsplit("/", 1)[1] for r in fresh] == ["a.csv"]


def test_contract_values_by_json_type(spark):
    cells = ['"x "', "5", "5.0", "5.25", "true", '"2024-01-02"', '"2024-01-02T08:00:00"', '""',
             "null", '"=A1"', "123456", "0.1"]
    raw = spark.createDataFrame(
        [("s", "b", i + 2, '{"c": %s}' % cell) for i, cell in enumerate(cells)],
        "sheet string, import_batch_id string, source_row_number bigint, source_data string")
    sheet = contract.variant_sheet(raw, "s", ["c"])

    def found(declared, required=False):
        entry = [ContractColumn("s", "c", declared, required)]
        rows = contract.value_issues(sheet, "s", entry).collect()
        return {code: sorted(r.source_row_number for r in rows if r.code == code)
                for code in {r.code for r in rows}}

    text = {"TEXT_SURROUNDING_WHITESPACE": [2], "FORMULA_NOT_ALLOWED": [11]}
    assert found("text", True) == {**text, "REQUIRED_VALUE_MISSING": [9, 10],
                                   "INVALID_TEXT": [3, 4, 5, 6, 12, 13]}
    assert found("integer") == {**text, "INVALID_INTEGER": [2, 5, 6, 7, 8, 11, 13]}
    assert found("decimal(5,1)") == {**text, "INVALID_DECIMAL": [2, 6, 7, 8, 11],
                                     "DECIMAL_SCALE_EXCEEDED": [5],
                                     "DECIMAL_PRECISION_EXCEEDED": [12]}
    assert found("date")["INVALID_DATE"] == [2, 3, 4, 5, 6, 11, 12, 13]
    assert found("datetime")["INVALID_DATETIME"] == [2, 3, 4, 5, 6, 7, 11, 12, 13]
    assert found("money")["UNKNOWN_CONTRACT_TYPE"] == [2, 3, 4, 5, 6, 7, 8, 11, 12, 13]


def test_structure_report():
    entries = [ContractColumn("s", c, "text", True) for c in ("a", "b")]
    assert contract.structure({}, entries)[0]["status"] == "MISSING"
    report = contract.structure({"s": ["b", "a", "a", None]}, entries)[0]
    assert report["extra"] == [""] and report["duplicates"] == ["a"]
    assert not report["order_matches"] and report["missing"] == []


def test_scale_of_doubles_and_decimals(spark):
    df = spark.sql("select * from values (2, 0.1D, 1.10), (3, 1e-7D, 1.23), (4, 1e22D, 1.00), "
                   "(5, 0.30000000000000004D, 0.10) as t(source_row_number, d, m)")
    rows = contract.value_issues(df, "s", [ContractColumn("s", "d", "decimal(30,1)", True),
                                           ContractColumn("s", "m", "decimal(9,1)", True)])
    got = sorted((r.column, r.source_row_number) for r in rows.collect())
    assert got == [("d", 3), ("d", 5), ("m", 3)]


def test_wide_numbers_are_judged_exactly(spark):
    from decimal import Decimal

    from pyspark.sql import types as T

    entries = [contract.ContractColumn("s", "a", "integer", True), contract.ContractColumn("s", "b", "decimal(18,2)", True)]
    rows = [(2, Decimal("9007199254740993.50"), Decimal("9999999999999999.99")), (3, Decimal("9007199254740993.00"), Decimal("10000000000000000.00"))]
    schema = T.StructType([T.StructField("source_row_number", T.LongType()), T.StructField("a", T.DecimalType(20, 2)), T.StructField("b", T.DecimalType(20, 2))])
    found = {(r.source_row_number, r.code) for r in contract.value_issues(spark.createDataFrame(rows, schema), "s", entries).collect()}
    assert found == {(2, "INVALID_INTEGER"), (3, "DECIMAL_PRECISION_EXCEEDED")}
    text = spark.createDataFrame([(r, str(a), str(b)) for r, a, b in rows], "source_row_number long, a string, b string")
    found = {(r.source_row_number, r.code) for r in contract.value_issues(text, "s", entries, from_text=True).collect()}
    assert found == {(2, "INVALID_INTEGER"), (3, "DECIMAL_PRECISION_EXCEEDED")}


def test_text_sheets_under_a_contract(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b,c,d\n12,1.50,2024-01-31,"two\nlines"\nabc,1.555,31.1.2024,=SUM(A1)\n,x,2024-01-31 10:00:00, padded\n', encoding="utf-8")
    sheet = landing.read_sheet(spark, str(tmp_path / "s.csv"), multi_line=True)
    entries = [contract.ContractColumn("s", n, t, True) for n, t in (("a", "integer"), ("b", "decimal(10,2)"), ("c", "date"), ("d", "text"))]
    found = sorted((r.source_row_number, r.column, r.code) for r in contract.value_issues(sheet, "s", entries, from_text=True).collect())
    assert found == [(3, "a", "INVALID_INTEGER"), (3, "b", "DECIMAL_SCALE_EXCEEDED"), (3, "c", "INVALID_DATE"), (3, "d", "FORMULA_NOT_ALLOWED"),
                     (4, "a", "REQUIRED_VALUE_MISSING"), (4, "b", "INVALID_DECIMAL"), (4, "d", "TEXT_SURROUNDING_WHITESPACE")]


def test_value_checks_stay_small_enough_to_be_compiled(spark, capsys):
    """HotSpot leaves methods of more than 8000 bytes to the interpreter."""
    import re

    from fixtures import sheets

    for name, df in sheets(spark).items():
        contract.value_issues(df, name, contract.default_contract()).explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000, (name, sizes)
