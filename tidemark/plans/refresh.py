"""Refresh of the marts: written aside, checked there, published by one log row.

``refresh`` rebuilds everything from a core.  ``refresh_changes`` works on a store: it reads the facts
of new batches only, adds them to the reduced state of the batches before, and finishes again
only the months whose sales, stock, as-of costs or master data have changed.
"""

from __future__ import annotations

import contextvars
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timezone
from functools import reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import month_of
from tidemark.model import MART_TABLES, MERGED_BY, MERGED_MAXIMA, Core, Marts, State
from tidemark.plans import marts as build
from tidemark.plans.reconcile import refresh_checks
from tidemark.plans.serve import mart_row_counts
from tidemark.session import work_folder, written

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("event_seq", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("at", T.TimestampType(), False),
    T.StructField("row_counts", T.StringType()),
    T.StructField("source_summary", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("published", T.StringType()),
])

# Marts with rows per month and product: a folder per month, so that a refresh writes changed months alone.
BY_MONTH = ("product_sales_monthly",)
# State that is read month by month.
STATE_BY_MONTH = ("product_days", "customer_months", "product_customers")


class RefreshFailed(RuntimeError):
    """The new marts do not agree with the core; the published ones are unchanged."""


def source_summary(core: Core) -> DataFrame:
    """Rows of eight core tables and three dates, one row."""
    counted = ("sales_orders", "sales_order_lines", "purchase_orders", "purchase_order_lines",
               "inventory_snapshots", "inventory_snapshot_lines", "expeditions", "vehicles")
    counts = [getattr(core, name).agg(F.count("*")).scalar().alias(name) for name in counted]
    last = core.expeditions.agg(F.max("expedition_date")).scalar()
    return core.sales_orders.agg(
        F.min("order_date").alias("sales_min"), F.max("order_date").alias("sales_max"),
    ).select(*counts, "sales_min", "sales_max", last.alias("expedition_max"))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Refresh runs, one row each, from the append-only log."""
    try:
        log = spark.read.schema(RUN_SCHEMA).parquet(f"{root}/refresh_log")
    except Exception as error:  # the log appears with the first run
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log = spark.createDataFrame([], RUN_SCHEMA)
    return log.groupBy("run_id").agg(
        F.max_by("status", "event_seq").alias("status"), F.min("at").alias("started_at"),
        F.max(F.when(F.col("event_seq") > 0, F.col("at"))).alias("finished_at"),
        F.max("row_counts").alias("row_counts"),
        F.max("source_summary").alias("source_summary"),
        F.max("error_message").alias("error_message"), F.max("published").alias("published"))


def latest_run(run_table: DataFrame) -> DataFrame:
    """The run started last."""
    return run_table.orderBy(F.col("started_at").desc()).limit(1)


def last_published(spark: SparkSession, root: str) -> dict | None:
    """What the newest completed run has published: run_id, months, and for a store batches, state and version."""
    last = runs(spark, root).where("status = 'completed'").orderBy(
        F.col("started_at").desc()).select("run_id", "published").first()
    return None if last is None else {"run_id": last.run_id, **json.loads(last.published)}


def published(spark: SparkSession, root: str) -> Marts | None:
    """The marts of the newest completed run."""
    last = last_published(spark, root)
    return None if last is None else stored_marts(spark, root, last["run_id"], last["months"])


def stored_marts(spark: SparkSession, root: str, run_id: str, months: dict[str, dict[str, str]]) -> Marts:
    """Marts of a run; of marts by month, each month's folder is that of the run that wrote it last."""
    def mart(name: str) -> DataFrame:
        own = f"{root}/refresh_id={run_id}/{name}"
        if not months.get(name):
            return spark.read.parquet(own)
        folders = [f"{root}/refresh_id={run}/{name}/month={month}" for month, run in sorted(months[name].items())]
        return spark.read.parquet(*folders)

    return Marts(**{name: (lambda n=name: mart(n)) for name in MART_TABLES})


def _log(spark: SparkSession, root: str, run_id: str, seq: int, status: str, **values) -> None:
    row = (run_id, seq, status, datetime.now(timezone.utc), values.get("row_counts"),
           values.get("source_summary"), values.get("error_message"), values.get("published"))
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{root}/refresh_log")


def side_by_side(spark: SparkSession, steps: dict[str, Callable]) -> dict:
    """Results of independent steps, three at a time."""
    with ThreadPoolExecutor(max_workers=3) as pool:
        contexts = [(name, contextvars.copy_context(), step) for name, step in steps.items()]
        work = inheritable_thread_target(spark)(lambda x: (x[0], x[1].run(x[2])))
        return dict(pool.map(work, contexts))


def _stored(df: DataFrame, path: str, by_month: bool) -> DataFrame:
    """Write ``df``, with ``by_month`` into a folder a month, and read it back."""
    spark = df.sparkSession
    if by_month:
        df.withColumn("month", F.date_format("month_start", "yyyy-MM-dd")).hint("rebalance", "month").write.partitionBy(
            "month").parquet(path)
        return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_state(spark: SparkSession, state: State, path: Callable[[str], str], by_month: bool = False) -> State:
    """The reduced tables, each written once: facts are read here and nowhere else."""
    return State(**side_by_side(spark, {name: (lambda n=name: _stored(
        getattr(state, n), path(n), by_month and n in STATE_BY_MONTH)) for name in State.names}))


def merged(parts: list[DataFrame], name: str) -> DataFrame:
    """One state table of several batches: one row a key."""
    rows = reduce(DataFrame.unionByName, parts)
    keys = MERGED_BY[name]
    return rows if len(parts) == 1 else rows.groupBy(*keys).agg(*[
        (F.max(c) if c in MERGED_MAXIMA else F.sum(c).cast(rows.schema[c].dataType)).alias(c)
        for c in rows.columns if c not in keys])


class Changed(NamedTuple):
    """Months to finish again."""

    sales: list[date]
    stock: list[date]


def write_marts(core: Core, path: str, state: State, changed: Changed | None = None,
                before: Marts | None = None) -> Marts:
    """Finish and write the seven marts; the management mart reads the written ones.

    With ``changed``, months outside it keep their rows of ``before``; of a mart by month only the changed
    months are written (and returned).  Costed product days feed two marts and are written once.
    """
    spark = core.products.sparkSession
    sold = stocked = state
    stock = build.stock_lines(core)
    if changed is not None:
        sold, stocked = (state.replace(**{n: (lambda n=n, m=m: getattr(state, n).where(F.col("month_start").isin(m)))
                                          for n in STATE_BY_MONTH}) for m in changed)
        stock = stock.where(month_of(F.col("month_start")).isin(changed.stock))

    def kept(name: str, rows: DataFrame, months: list[date] | None) -> DataFrame:
        if months is None:
            return rows
        return rows.unionByName(getattr(before, name).where(~month_of(F.col("month_start")).isin(months)))

    costed = written(build.costed_product_days(core, sold), "costed_days")
    plans = {
        "inventory_health_monthly": lambda: kept(
            "inventory_health_monthly", build.inventory_health_monthly(core, stocked, stock), changed and changed.stock),
        "product_sales_monthly": lambda: build.product_sales_monthly(core, sold, costed),
        "sales_monthly": lambda: kept("sales_monthly", build.sales_monthly(core, sold, costed), changed and changed.sales),
        "procurement_supplier_monthly": lambda: build.procurement_supplier_monthly(core, state),
        "expedition_monthly": lambda: build.expedition_monthly(core, state),
        "vehicle_utilization_monthly": lambda: build.vehicle_utilization_monthly(core, state),
    }
    done = side_by_side(spark, {name: (lambda n=name: _stored(plans[n](), f"{path}/{n}", n in BY_MONTH))
                                for name in plans})
    name = "management_kpis_monthly"
    done[name] = _stored(build.management_kpis_monthly(
        done["sales_monthly"], done["inventory_health_monthly"], done["procurement_supplier_monthly"],
        done["expedition_monthly"], done["vehicle_utilization_monthly"]), f"{path}/{name}", False)
    return Marts(**done)


def _run(spark: SparkSession, root: str, core: Core, work: Callable[[str], tuple[Marts, dict]]) -> str:
    """Log, work, check, publish: ``work`` gives the marts of a run id and what to publish beside it."""
    run_id = str(uuid.uuid4())
    summary = source_summary(core).select(F.to_json(F.struct("*")).alias("j")).first().j
    _log(spark, root, run_id, 0, "running", source_summary=summary)
    try:
        with work_folder(spark, f"{root}/refresh_id={run_id}/_work"):
            marts, shown = work(run_id)
        failed = [row.check_name for row in refresh_checks(core, marts).collect()
                  if not row.valid]
        if failed:
            raise RefreshFailed("Mart validation failed: " + ", ".join(failed))
        counts = {row.mart: row.row_count for row in mart_row_counts(marts).collect()}
        _log(spark, root, run_id, 1, "completed", row_counts=json.dumps(counts), published=json.dumps(shown))
    except Exception as error:
        _log(spark, root, run_id, 1, "failed", error_message=str(error))
        raise
    return run_id


def _months(df: DataFrame) -> list[date]:
    """Distinct months of ``month_start``: as many as the calendar has."""
    return [r.m for r in df.select(month_of(F.col("month_start")).alias("m")).distinct().collect()]


def _written_months(marts: Marts, run_id: str) -> dict[str, dict[str, str]]:
    return {name: {m.isoformat(): run_id for m in _months(getattr(marts, name))} for name in BY_MONTH}


def refresh(spark: SparkSession, core: Core, root: str) -> str:
    """Replace all marts or none; returns the run id."""
    def work(run_id: str) -> tuple[Marts, dict]:
        path = f"{root}/refresh_id={run_id}"
        state = write_state(spark, build.reduced(core), lambda name: f"{path}/_work/{name}")
        marts = write_marts(core, path, state)
        return marts, {"months": _written_months(marts, run_id)}

    return _run(spark, root, core, work)


# --- refresh by month -----------------------------------------------------------------------------

def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of ``new`` that are not in ``old`` or have other values in ``columns`` there."""
    values = F.struct(*columns)
    before = old.select(F.col(key).alias("_key"), values.alias("_before"))
    return new.select(key, values.alias("_now")).join(before, F.col(key) == F.col("_key"), "left").where(
        ~F.col("_now").eqNullSafe(F.col("_before"))).select(key)


def changed_months(core: Core, old: Core, state: State, added: State, new_stock: DataFrame) -> Changed:
    """Months that a refresh has to finish again.

    Those with new sales (stock months too, for their cover) or new snapshots; those from a product's first
    new purchase day on in which it is sold or stocked, as its as-of cost may differ; and those of
    products whose master data has changed.
    """
    listed = ["product_id", "product_name", "category", "purchase_price", "sales_price", "supplier_name"]

    def catalogue(of: Core) -> DataFrame:
        names = of.suppliers.select(F.col("id").alias("supplier_id"), "supplier_name")
        return of.products.join(names, "supplier_id", "left").select(*listed)

    touched = (
        added.price_points.groupBy("product_id").agg(F.min("price_date").alias("since"))
        .unionByName(changed_rows(catalogue(old), catalogue(core), "product_id", listed[1:]).select(
            "product_id", F.lit("0001-01-01").cast("date").alias("since")))
        .groupBy("product_id").agg(F.min("since").alias("since"))
    )
    touched = written(touched, "touched_products")

    def affected(rows: DataFrame, day: str) -> DataFrame:
        return rows.join(touched, "product_id").where(F.col(day) >= F.col("since")).select("month_start")

    new_sales = added.product_days.select("month_start")
    sales = affected(state.product_days, "order_date").unionByName(new_sales)
    stock = affected(build.stock_lines(core), "month_start").unionByName(new_sales).unionByName(new_stock.select("month_start"))
    return Changed(sorted(_months(sales)), sorted(_months(stock)))


def refresh_changes(store, root: str) -> str:
    """S15 over a store of batches: as ``refresh``, with work in proportion to what has changed.

    State of supplier totals depends on the products' standard lead time, state of vehicle days on the
    vehicles' capacity: where a batch changes those of a known product or vehicle, that state is built anew.
    """
    spark, core = store.spark, store.core()
    if core is None:
        raise RefreshFailed("there is no completed batch")
    last = last_published(spark, root)
    if last is not None and "state" not in last:
        last = None     # published by a refresh without state
    done = store.completed()
    known = set(last["batches"]) if last else set()
    new = [b for b in done if b not in known]
    facts = store.core(new)

    def work(run_id: str) -> tuple[Marts, dict]:
        path = f"{root}/refresh_id={run_id}"

        def of(run: str, name: str) -> str:
            return f"{root}/state/{name}/run={run}"

        anew: set[str] = set(State.names)
        if last:
            old = store.core(version=last["version"])
            pairs = (("supplier_totals", "products", "product_id", ["lead_time_days"]),
                     ("vehicle_days", "vehicles", "vehicle_id", ["capacity_kg", "capacity_m3"]))
            anew = {name for name, table, key, columns in pairs if not changed_rows(
                getattr(old, table), getattr(core, table).join(getattr(old, table).select(key), key, "left_semi"),
                key, columns).isEmpty()}
        whole, part = build.reduced(core), build.reduced(core, facts)
        fresh = State(**{n: (lambda n=n: getattr(whole if n in anew else part, n)) for n in State.names})
        added = write_state(spark, fresh, lambda name: of(run_id, name), by_month=True)
        sources = {n: [run_id] if n in anew else [*last["state"][n], run_id] for n in State.names}

        def read(name: str) -> DataFrame:
            schema = getattr(added, name).schema
            return merged([spark.read.schema(schema).option("recursiveFileLookup", True).parquet(of(run, name))
                           if name not in STATE_BY_MONTH else _by_month(spark, of(run, name), schema) for run in sources[name]], name)

        state = State(**{n: (lambda n=n: read(n)) for n in State.names})
        shown = {"batches": done, "state": sources, "version": store.newest()}
        if not last:
            marts = write_marts(core, path, state)
            return marts, {**shown, "months": _written_months(marts, run_id)}
        months = changed_months(core, old, state, added, build.stock_lines(facts))
        before = stored_marts(spark, root, last["run_id"], last["months"])
        marts = write_marts(core, path, state, months, before)
        months_of = {name: {**last["months"][name], **own} for name, own in _written_months(marts, run_id).items()}
        return stored_marts(spark, root, run_id, months_of), {**shown, "months": months_of}

    return _run(spark, root, core, work)


def _by_month(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """State kept in a folder a month: a filter on ``month_start`` prunes folders."""
    own = T.StructType([f for f in schema.fields if f.name != "month_start"])
    rows = spark.read.schema(T.StructType([*own.fields, T.StructField("month", T.DateType())])).parquet(path)
    return rows.select(*[F.col("month").alias("month_start") if f.name == "month_start" else f.name for f in schema.fields])
