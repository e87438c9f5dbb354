import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from fixtures import input_sheets

from tidemark.model import MART_TABLES, Core
from tidemark.plans import audit, importing, reconcile, refresh, serve

SHA = "a" * 64


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return importing.Store(spark, str(tmp_path_factory.mktemp("warehouse")))


@pytest.fixture(scope="module")
def first(spark, store):
    return importing.import_sheets(store, input_sheets(spark), SHA, original_filename="one.xlsx")


def _counts(core):
    return {name: df.count() for name, df in core.items()}


def test_clean_batch_completes(store, first):
    batch_id, status = first
    assert status == "completed"
    row = store.batches().where(f"batch_id = '{batch_id}'").first()
    assert row.row_count_raw == 21 and row.error_count == 0
    counts = json.loads(row.metadata["core_row_counts"])
    assert counts["sales_orders"] == 3 and counts["sales_order_lines"] == 4
    assert counts["suppliers"] == 2 and row.row_count_core == sum(counts.values())
    assert audit.batch_violations(store.batches()).count() == 0


def test_same_content_is_a_no_op(spark, store, first):
    before = _counts(store.core())
    assert importing.import_sheets(store, input_sheets(spark), SHA.upper()) == first
    assert _counts(store.core()) == before and store.batches().count() == 1


def test_repeating_rows_reject_the_batch_and_leave_core(spark, store, first):
    before = _counts(store.core())
    batch_id, status = importing.import_sheets(store, input_sheets(spark), "b" * 64)
    assert status == "rejected" and _counts(store.core()) == before
    def found():
        rows = store.issues().where(f"import_batch_id = '{batch_id}'").collect()
        return sorted(r.rule_code for r in rows)

    before = found()
    assert set(before) == {"CORE-E001", "CORE-E002", "CORE-E003", "CORE-E004"}
    importing.validate(store, batch_id)     # replaces the issues of the batch
    assert found() == before


def test_next_batch_upserts_dimensions(spark, store, first):
    changes = [("sales", i, "order_id", f"T{i}") for i in range(4)]
    changes += [("expedition", i, "order_id", o) for i, o in enumerate(("T0", "T2", "T3"))]
    changes += [("purchases", i, "purchase_order_id", f"M{i}") for i in range(2)]
    changes += [("inventory", i, "snapshot_date", date(2024, 5 + i // 2, 1)) for i in range(8)]
    changes += [("products", 0, "sales_price", D("9.00")),
                ("products", 1, "supplier", "Nový dodávateľ")]
    extra = [("expedition", ["T1", *_row(spark)])]
    batch_id, status = importing.import_sheets(store, input_sheets(spark, changes, extra), "c" * 64)
    assert status == "completed"
    core = store.core()
    names = {r.supplier_name: r.id for r in core.suppliers.collect()}
    assert sorted(names.values()) == [1, 2, 3] and names["Nový dodávateľ"] == 3
    prices = {r.product_id: r.sales_price for r in core.products.collect()}
    assert prices["P1"] == D("9.00") and core.sales_orders.count() == 7
    assert audit.batch_totals(store.batches()).first().batch_count == 3


def _row(spark):
    from fixtures import EXPEDITION
    return EXPEDITION[0][1:]


def test_bad_input_fails_before_a_batch_exists(spark, store, first):
    broken = input_sheets(spark)
    broken["sales"] = broken["sales"].toDF(*["source_row_number", *[""] * 10])
    with pytest.raises(importing.landing.BadHeader):
        importing.import_sheets(store, broken, "d" * 64)
    assert store.batches().where("file_sha256 = '" + "d" * 64 + "'").count() == 0


CORRUPT = {
    "unique product": [("products", ["P1", "Skrutka", "A", "ks", D("5.00"), D("7.00"), "Dodávateľ A", 5, 10, D("1.500"), D("0.01000")])],
    "unique expedition": [("expedition", ["S1", None, None, date(2024, 1, 3), "vlastná", "V1", "BA", D("4.00"), D("0.028")])],
    "missing quantity": [("sales", ["S9", date(2024, 1, 1), "P1", None, D("6.00"), "C1", "Zákazník 1", "BA", "vybavená", date(2024, 1, 3)])],
    "missing order": [("sales", [None, date(2024, 1, 1), "P1", 2, D("6.00"), "C1", "Zákazník 1", "BA", "vybavená", date(2024, 1, 3)])],
}


@pytest.mark.parametrize("case", CORRUPT)
def test_corrupt_batches_are_refused_and_leave_core(spark, store, first, case):
    before = _counts(store.core())
    sheets = input_sheets(spark, [], CORRUPT[case])
    sha = f"{sorted(CORRUPT).index(case)}" * 64
    with pytest.raises(importing.InputRejected):
        importing.import_sheets(store, sheets, sha)
    assert store.batches().where(f"file_sha256 = '{sha}'").count() == 0     # nothing registered
    with pytest.raises(importing.ConstraintBroken, match="unique|not null"):
        importing.import_sheets(store, sheets, sha, gate=False)
    assert store.batches().where(f"file_sha256 = '{sha}'").first().status == "raw_loaded"
    assert _counts(store.core()) == before


def test_core_constraints(spark, store, first):
    core = store.core()
    assert importing.core_violations(core, core).count() == 0
    twice = core.replace(expeditions=core.expeditions.unionByName(core.expeditions))
    assert {(r.table_name, r.rule) for r in importing.core_violations(twice, core).collect()} == {("expeditions", "unique")}
    orphans = core.replace(products=core.products.where("product_id <> 'P1'"))
    found = {(r.table_name, r.columns) for r in importing.core_violations(core, orphans).collect()}
    assert ("sales_order_lines", "product_id") in found


def test_warnings_pass_the_gate_and_are_counted(spark, store, first):
    changes = [("sales", i, "order_id", f"W{i}") for i in range(4)]
    changes += [("expedition", i, "order_id", o) for i, o in enumerate(("W0", "W2", "W3"))]
    changes += [("purchases", i, "purchase_order_id", f"WN{i}") for i in range(2)]
    changes += [("inventory", i, "snapshot_date", date(2030, 5 + i // 2, 1)) for i in range(8)]
    changes += [("vehicles", 0, "cost_per_km", D("0.00"))]
    verdict = importing.check_input(input_sheets(spark, changes, [("expedition", ["W1", *_row(spark)])]))
    assert verdict["error_count"] == 0 and verdict["business"]["BIZ-W004"] == 1
    wide = input_sheets(spark)
    wide["sales"] = wide["sales"].withColumnRenamed("quantity", "pieces")
    assert importing.check_input(wide)["sheets"] == {"sales": "DIFFERENT"}


def test_report_of_a_batch(spark, store, first):
    batch_id, _ = first
    report = json.loads(spark.read.text(store.path("audit", "reports", f"import_batch_id={batch_id}")).first().value)
    assert report["row_counts"]["raw"]["total"] == 21 and report["batch"]["status"] == "completed"
    row = store.batches().where(f"batch_id = '{batch_id}'").first()
    assert json.loads(row.metadata["layer_totals"])["staging"] == 21 and row.warning_count is not None


def test_refresh_publishes_and_failed_refresh_keeps_the_old_marts(spark, store, first, tmp_path):
    core, root = store.core(), str(tmp_path / "marts")
    assert refresh.published(spark, root) is None
    run = refresh.refresh(spark, core, root)
    marts = refresh.published(spark, root)
    left = {p.name for p in (tmp_path / "marts" / f"refresh_id={run}").iterdir()}
    assert left == set(MART_TABLES)     # nothing else stays behind
    row = refresh.latest_run(refresh.runs(spark, root)).first()
    assert (row.run_id, row.status) == (run, "completed")
    assert set(json.loads(row.row_counts)) == set(MART_TABLES)
    assert all(r.valid for r in reconcile.published_checks(core, marts).collect())
    assert reconcile.latest_run_status(refresh.runs(spark, root)).first().valid

    sales = {r.month_start: r for r in marts.sales_monthly.collect()}
    january = sales[date(2024, 1, 1)]
    # first batch before any purchase: master price; the second repeats the same dates
    assert january.revenue == D("48.00") and january.order_count == 3
    february = sales[date(2024, 2, 1)]
    assert february.estimated_cost == D("12.00") and february.fallback_cost_line_count == 0

    spine = [r.month_start.month for r in serve.monthly(marts).collect()]
    assert spine == [1, 2, 3, 4, 5, 6, 7, 8]
    fleet = {(r.month_start, r.vehicle_id): r for r in
             marts.vehicle_utilization_monthly.collect()}
    idle = fleet[date(2024, 2, 1), "V2"]
    assert idle.trip_count == 0 and idle.average_weight_utilization_pct is None

    # lines without a header reach no mart: the revenue check fails, the old marts stay
    broken = core.replace(sales_orders=core.sales_orders.where("order_id <> 'S1'"))
    with pytest.raises(refresh.RefreshFailed, match="sales revenue"):
        refresh.refresh(spark, broken, root)
    assert refresh.latest_run(refresh.runs(spark, root)).first().status == "failed"
    assert refresh.published(spark, root).sales_monthly.count() == len(sales)
    with pytest.raises(refresh.RefreshFailed):
        refresh.refresh(spark, core.replace(
            **{n: df.limit(0) for n, df in core.items()}), root)
    assert serve.status(marts, refresh.runs(spark, root)).first().status == "not_ready"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def assert_same_marts(spark, store, root, tmp_path, name):
    """Marts refreshed by month equal those of a full refresh."""
    other = str(tmp_path / name)
    refresh.refresh(spark, store.core(), other)
    by_month, full = refresh.published(spark, root), refresh.published(spark, other)
    for mart in MART_TABLES:
        assert rows_of(getattr(by_month, mart).select(getattr(full, mart).columns)) == rows_of(getattr(full, mart)), mart


def moved(months, prefix, day=date(2024, 7, 1)):
    """The fixture's orders as new ones, all in one month; its purchases and snapshots later."""
    changes = [("sales", i, "order_id", f"{prefix}{i // 2}") for i in range(4)]
    changes += [("sales", i, c, v) for i in range(4) for c, v in (
        ("order_date", day), ("expedition_date", day.replace(day=9)), ("customer_id", "C1"), ("customer_name", "Zákazník 1"), ("region", "BA"))]
    changes += [("expedition", i, c, v) for i in range(2) for c, v in (
        ("order_id", f"{prefix}{i}"), ("received_at", datetime(day.year, day.month, 2, 8)), ("picked_at", datetime(day.year, day.month, 2, 9)),
        ("expedition_date", day.replace(day=9)), ("region", "BA"))]
    changes += [("purchases", i, c, v) for i in range(2) for c, v in (
        ("purchase_order_id", f"{prefix}N{i}"), ("order_date", day), ("delivery_date", day.replace(day=20 + i)))]
    changes += [("inventory", i, "snapshot_date", date(months, 1 + i // 2, 1)) for i in range(8)]
    return changes


def test_refresh_by_month(spark, tmp_path):
    store, root = importing.Store(spark, str(tmp_path / "warehouse")), str(tmp_path / "marts")
    with pytest.raises(refresh.RefreshFailed):
        refresh.refresh_changes(store, root)
    def load(sha, changes, drop=None):
        sheets = input_sheets(spark, changes)
        if drop:
            sheets["expedition"] = sheets["expedition"].where(drop)
        assert importing.import_sheets(store, sheets, sha * 64, gate=False)[1] == "completed"
        return refresh.refresh_changes(store, root)

    first = load("1", [])
    assert set(refresh.last_published(spark, root)["months"]["product_sales_monthly"].values()) == {first}

    # orders and purchases of July, snapshots of 2025: earlier months stay as they were written
    second = load("2", moved(2025, "T"), "order_id <> 'S3'")
    months = refresh.last_published(spark, root)["months"]["product_sales_monthly"]
    assert {m: run == second for m, run in months.items()} == {
        "2024-01-01": False, "2024-02-01": False, "2024-04-01": False, "2024-07-01": True}
    written = {p.name for p in (tmp_path / "marts" / f"refresh_id={second}" / "product_sales_monthly").iterdir() if p.is_dir()}
    assert written == {"month=2024-07-01"}

    # purchases in January change the costs of P1 from then on; P2 and its April sales keep theirs
    third = load("3", moved(2026, "U", date(2024, 1, 1)), "order_id <> 'S3'")
    assert_same_marts(spark, store, root, tmp_path, "full3")
    months = refresh.last_published(spark, root)["months"]["product_sales_monthly"]
    assert {m for m, run in months.items() if run == third} == {"2024-01-01", "2024-02-01", "2024-07-01"}

    # master data: a price for every month of the product, lead times and capacities for the state made with them
    changes = moved(2027, "W", date(2024, 9, 1)) + [
        ("products", 1, "purchase_price", D("2.50")), ("products", 0, "lead_time_days", 60), ("vehicles", 0, "capacity_kg", 3)]
    load("4", changes, "order_id <> 'S3'")
    assert_same_marts(spark, store, root, tmp_path, "full4")
    state = refresh.last_published(spark, root)["state"]
    assert [len(state[n]) for n in ("product_days", "supplier_totals", "vehicle_days")] == [4, 1, 1]

    # nothing new: nothing is written by month
    last = refresh.refresh_changes(store, root)
    assert last not in refresh.last_published(spark, root)["months"]["product_sales_monthly"].values()


def test_building_marts_starts_no_job(spark, store, first):
    from tidemark.plans import marts
    core = Core(**dict(store.core().items()))   # opened before: a Parquet file's schema is read by a job
    spark.sparkContext.setJobGroup("building", "building")
    assert marts.all_marts(core).management_kpis_monthly.schema
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == 0
