import random
from datetime import date, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from tidemark.operators.asof import packed_points, price_points, unpacked, with_price_as_of
from tidemark.operators.duplicates import repeated_rows, variants
from tidemark.operators.median import grouped_median
from tidemark.operators.numbering import dense_ids, number_within
from tidemark.operators.upsert import upsert

DAY = date(2024, 1, 1)


def _asof(spark, purchases, asked):
    orders = spark.createDataFrame(
        [(i, p[1]) for i, p in enumerate(purchases)], "purchase_order_id int, order_date date")
    lines = spark.createDataFrame(
        [(i, 1, p[0], p[2], p[3], i + 2) for i, p in enumerate(purchases)],
        "purchase_order_id int, line_number int, product_id int, delivery_date date, "
        "purchase_price decimal(10,2), source_row_number long")
    demand = spark.createDataFrame(asked, "product_id int, day date")
    found = with_price_as_of(demand, price_points(orders, lines), "day")
    return {(r.product_id, r.day): r.historical_price for r in found.collect()}


def _brute(purchases, product, day):
    known = [(p[1], p[2], i, p[3]) for i, p in enumerate(purchases)
             if p[0] == product and p[1] <= day]
    return max(known)[3] if known else None


def test_price_points_pack_and_merge(spark):
    """Latest delivery, then batch, then sheet row; extreme values; no sorting of lines; batches merge by the maximum."""
    top, low = D("99999999.99"), D("-99999999.99")
    orders = spark.createDataFrame([(i, DAY) for i in range(9)], "purchase_order_id int, order_date date")
    rows = [(0, 1, DAY, D("1.00"), 1, 9), (1, 1, DAY + timedelta(1), D("2.00"), 1, 2), (2, 1, DAY, D("3.00"), 2, 9),
            (3, 2, DAY, D("1.00"), 1, 9), (4, 2, DAY, D("2.00"), 1, 10), (5, 2, DAY, D("9.00"), 0, 11),
            (6, 3, date(9999, 12, 31), top, 2 ** 22, 2 ** 40 - 1), (7, 4, date(1, 1, 1), low, 0, 2), (8, 4, date(1, 1, 1), D("0.00"), 0, 1)]
    lines = spark.createDataFrame(rows, "purchase_order_id int, product_id int, delivery_date date, purchase_price decimal(10,2), "
                                        "batch_seq long, source_row_number long")
    points = packed_points(orders, lines)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert {r.product_id: r.price for r in unpacked(points).collect()} == {1: D("2.00"), 2: D("2.00"), 3: top, 4: low}
    parts = [packed_points(orders, lines.where(f"batch_seq % 2 = {i}")) for i in (0, 1)]
    merged = parts[0].unionByName(parts[1]).groupBy("product_id", "price_date").agg(F.max("packed").alias("packed"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, points.collect()))


def test_asof_equals_brute_force_with_a_hot_product(spark):
    rng = random.Random(7)
    purchases = []
    for _ in range(600):
        product = 1 if rng.random() < 0.4 else rng.randint(2, 30)
        ordered = DAY + timedelta(rng.randint(0, 90))
        purchases.append((product, ordered, ordered + timedelta(rng.randint(0, 5)),
                          D(rng.randint(1, 999)) / 100))
    asked = sorted({(rng.choice([1, rng.randint(1, 33)]), DAY + timedelta(rng.randint(-5, 95)))
                    for _ in range(500)})
    got = _asof(spark, purchases, asked)
    assert got == {key: _brute(purchases, *key) for key in asked}


def test_asof_same_day_counts_and_later_delivery_wins(spark):
    purchases = [(1, DAY, DAY + timedelta(9), D("5.00")), (1, DAY, DAY + timedelta(3), D("4.00"))]
    got = _asof(spark, purchases, [(1, DAY), (1, DAY - timedelta(1))])
    assert got == {(1, DAY): D("5.00"), (1, DAY - timedelta(1)): None}


def test_median_is_exact(spark):
    rng = random.Random(3)
    rows = []
    for group in range(6):
        for _ in range(rng.randint(1, 400)):
            value = 5 if rng.random() < 0.35 else rng.randint(-1000, 10 ** rng.randint(1, 7))
            rows.append((group, value))
    rows += [(9, None), (0, None)]
    df = spark.createDataFrame(rows, "g int, v bigint")
    got = {r.g: float(r.median) for r in grouped_median(df, ["g"], "v").collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()
            if r.m is not None}
    assert got == want


def test_row_numbers_across_blocks(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i) for i in range(2, 2000)]
    df = spark.createDataFrame(rows, "k string, r bigint")
    got = {(x.k, x.r): x.n for x in number_within(df, "k", "r", "n", block_rows=64).collect()}
    seen: dict = {}
    for key, row in rows:
        seen[key] = seen.get(key, 0) + 1
        assert got[key, row] == seen[key]


def test_dense_ids_are_dense_and_repeatable(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(500)], "name string")
    first = {r.name: r.id for r in dense_ids(names, "name", F.lit(40)).collect()}
    again = {r.name: r.id for r in dense_ids(names.repartition(7), "name", F.lit(40)).collect()}
    assert first == again and sorted(first.values()) == list(range(41, 541))


def test_repeated_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, 2), ("a", 3), (None, 4), ("b", 5), (None, 6), ("a", 7)],
                               "k string, r int")
    got = sorted((r.r, r.first_row) for r in repeated_rows(df, ["k"], "r").collect())
    assert got == [(4, 2), (6, 2), (7, 3)]


def test_variants_count_nulls(spark):
    df = spark.createDataFrame([("o", "a", None, 2), ("o", "a", 1, 3), ("p", "a", None, 4),
                                ("p", "a", None, 5)], "k string, x string, y int, r int")
    got = {r.k: (r.variant_count, r.r) for r in variants(df, "k", ["x", "y"], "r").collect()}
    assert got == {"o": (2, 2), "p": (1, 4)}


def test_upsert_replaces_values_and_keeps_creation(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, created_at string")
    new = spark.createDataFrame([(2, None, "t1"), (3, "c", "t1")], "k int, v string, created_at string")
    got = {r.k: (r.v, r.created_at) for r in upsert(old, new, ["k"]).collect()}
    assert got == {1: ("a", "t0"), 2: (None, "t0"), 3: ("c", "t1")}
