"""Plans whose sizes Spark must not mistake: derived stock, rows numbered by position."""

import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import with_price_as_of
from tidemark.operators.findings import explode_where
from tidemark.plans import contract, marts
from tidemark.registry.marts import QUERIES as MART_QUERIES
from tidemark.registry.marts import stored_marts
from tidemark.registry.portable import portable
from tidemark.registry.sheet_checks import QUERIES as CHECK_QUERIES
from tidemark.registry.sheet_sql import flawed_sheets
from tidemark.session import configure, written
from tidemark.sources import landing
from tidemark.sources.tables import TABLE_SCHEMAS, core_from_tables

PARTS, MONTHS = 3000, 120


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    day = lambda i: datetime(1990, 1, 15) + timedelta(days=31 * i)
    rows = {
        "nation": [(0, "N", 0)], "supplier": [(1, "S", 0, 1.0)], "customer": [(1, "C", 0, 1.0, "A")],
        "part": [(i, f"part {i}", "B", "T", i % 50, 9.5) for i in range(PARTS)] + [(None, "no key", "B", "T", 1, 9.5)],
        "orders": [(i, 1, "O", 10.0, day(i), "1") for i in range(MONTHS)] + [(MONTHS, 1, "O", 10.0, None, "1")],
        "lineitem": [(i, i, 1, 1, 2.0, 10.0, 0.0, 0.0, "RN"[i % 2], "F", day(i)) for i in range(MONTHS + 1)],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, TABLE_SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_derived_stock_is_not_taken_for_small(spark, tables):
    """Its estimate covers its rows, so that no join broadcasts it; keys and months may be missing."""
    sheet, core = flawed_sheets(spark, tables).inventory, core_from_tables(spark, tables)
    assert sheet.count() == (PARTS + 1) * MONTHS
    assert estimate(sheet) > 16 * sheet.count()
    lines = core.inventory_snapshot_lines
    assert lines.count() == (PARTS + 1) * MONTHS // 2
    assert estimate(lines) > 16 * lines.count()
    plan = marts.stock_lines(core)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[snapshot_id.*BuildLeft", plan), plan


def test_derived_stock_is_dealt_out(spark, tables):
    """One file of keys makes many rows: they are not left to the task that reads it."""
    stock = flawed_sheets(spark, tables).inventory
    assert stock.selectExpr("spark_partition_id() as p").distinct().count() > 1


def test_rows_numbered_by_position_are_not_shuffled(spark, tables):
    """However large the table, its rows do not go to the task of their file."""
    sheet = landing.numbered_by_position(spark.read.parquet(f"{tables}/part.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sheet._jdf.queryExecution().executedPlan().toString()
        numbers = {r[0] for r in sheet.select("source_row_number").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, plan
    assert numbers == set(range(2, PARTS + 3))


def test_findings_are_built_before_they_are_exploded(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "k long, v string")
    found = explode_where(rows, [(F.col("v").isNull(), F.struct(F.lit("v").alias("c"), "k")),
                                 (F.col("k").isNull(), F.struct(F.lit("k").alias("c"), "k"))])
    assert sorted(map(tuple, found.collect()), key=str) == [("k", None), ("v", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(_all#" in plan, plan


def test_order_keys_are_not_broadcast(spark):
    """A few megabytes of keys by Spark's estimate take many times as much in the driver: they are joined by a shuffle."""
    configure(spark)
    keys, lines = spark.range(500_000), spark.range(4_000_000)
    for join in (lines.join(keys, "id"), lines.join(keys.distinct(), "id", "left_semi")):
        assert join.count() == 500_000
        total = join.agg(F.count("*"))
        total.collect()
        plan = total._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan


def test_management_mart_is_built_step_by_step(spark, tables):
    """One plan of all marts fills the driver: its inputs are written, the last step reads those alone."""
    core = core_from_tables(configure(spark), tables)
    for name, plain in (("m07_management_kpis_monthly", marts.all_marts(core).management_kpis_monthly),
                        ("m07b_month_spine", marts.month_spine(marts.mart_months(*[
                            getattr(marts.all_marts(core), mart) for mart in (
                                "sales_monthly", "inventory_health_monthly", "procurement_supplier_monthly",
                                "expedition_monthly")])))):
        built = MART_QUERIES[name](spark, tables)
        read = built.inputFiles()
        assert read and not [f for f in read if f.startswith(f"file://{tables}")], read
        assert sorted(map(str, built.collect())) == sorted(map(str, portable(plain).collect()))


def test_marts_share_the_reduced_tables(spark, tables, monkeypatch):
    """Product days are built and written once, however many marts are finished from them."""
    calls, product_days = [], marts.product_days
    monkeypatch.setattr(marts, "product_days", lambda core: calls.append(1) or product_days(core))
    stored_marts(core_from_tables(configure(spark), tables)).management_kpis_monthly.count()
    assert calls == [1]


def test_plan_texts_are_bounded(spark, tables):
    """The driver keeps the text of each plan it runs."""
    plan = marts.all_marts(core_from_tables(configure(spark), tables)).management_kpis_monthly
    assert len(plan._jdf.queryExecution().toString()) < 200_000


def test_written_steps_leave_no_shuffle_files(spark):
    """Else the disk fills with the shuffles of all steps before, until the driver's heap happens to be collected."""
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffles()
    rows = written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "steps")
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert rows.count() == 1000 and rows.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_stored_inventory_deals_stock_out_once(spark, tables, monkeypatch):
    """Its lines are shuffled by product alone; sums and medians are those of the plan that joins them anew."""
    import tidemark.registry.marts as registered

    plans = {}

    def kept(df, name):
        out = written(df, name)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(registered, "written", kept)
    core = core_from_tables(configure(spark), tables)
    stored = stored_marts(core).inventory_health_monthly
    lines = plans["inventory_lines"]
    assert "Exchange hashpartitioning(snapshot_id" not in lines, lines
    assert "Exchange hashpartitioning(month_start" not in lines.split("Union", 1)[0], lines
    assert not re.search(r"Scan parquet (?!.*inventory_lines)", plans["inventory_health_monthly"]), plans["inventory_health_monthly"]
    plain = marts.inventory_health_monthly(core)
    assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect()))


def test_values_of_a_day_travel_with_prices(spark):
    """As a left join by product and day: a day between, a missing one, repeated rows and unknown products have none."""
    day = lambda n: datetime(2020, n, 1).date()
    asked = spark.createDataFrame([(1, day(2), 5), (1, day(2), 5), (1, day(3), 6), (1, None, 7), (2, day(2), 8), (None, day(2), 9), (3, day(1), 1)],
                                  "product_id long, d date, stock long")
    points = spark.createDataFrame([(1, day(1), 3), (1, day(3), 4), (3, day(2), 9)], "product_id long, price_date date, price long")
    values = spark.createDataFrame([(1, day(2), 50), (1, None, 60), (2, day(1), 70), (3, day(1), None)], "product_id long, d date, units long")
    got = with_price_as_of(asked, points, "d", on_day=values)
    want = with_price_as_of(asked, points, "d").join(values, ["product_id", "d"], "left")
    assert got.columns == ["product_id", "d", "stock", "historical_price", "units"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_business_rollup_runs_its_checks_one_at_a_time(spark, tables):
    """The last step reads stored counts and examples alone; they are those of one plan over all findings."""
    built = CHECK_QUERIES["c14_business_rollup"](spark, tables)
    read = built.inputFiles()
    assert read and not [f for f in read if f.startswith(f"file://{tables}")], read
    assert built.count() > 5


def test_rollup_by_parts_is_that_of_all_issues(spark):
    """Codes in several parts, with ties, nulls and keys that count once however many parts name them."""
    rows = [("ERROR", f"E{i % 3}", i * 7 % 20 if i % 9 else None, f"k{i % 4}" if i % 5 else None) for i in range(90)]
    issues = spark.createDataFrame(rows, "level string, code string, n long, key string").distinct()
    once = F.when(F.col("code") == "E1", F.coalesce("key", F.lit("")))
    args = [F.col("n").asc_nulls_last(), "key"], F.concat_ws("!", "n", "key")
    want = contract.issue_rollup(issues, *args, 4, once)
    parts = [issues.where(f"coalesce(n, 1) % 3 = {k}") for k in range(3)] + [issues.where("false")]
    stored = []
    got = contract.stored_rollup(parts, *args, lambda df, name: stored.append(name) or written(df, name), 4, once)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and len(stored) == 4
