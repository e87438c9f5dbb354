"""Import of one set of sheets: raw, staging, rules, core; every step can be repeated.

The store is a folder of Parquet tables.  Nothing is updated in place: raw, staging, issues and
core facts are partitioned by batch and overwritten per batch, dimensions are written as a new
version, and a batch counts only once the event log says ``completed``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import (
    CORE_KEYS, CORE_REFERENCES, CORE_TABLES, ISSUE_SCHEMA, SHEET_KEYS, SHEETS, Core, Sheets, staging_schema,
)
from tidemark.operators.upsert import upsert
from tidemark.plans import audit, contract, core_load, rules, sheet_rules, staging
from tidemark.sources import landing

DIMENSIONS = {"suppliers": ["supplier_name"], "customers": ["customer_id"],
              "products": ["product_id"], "vehicles": ["vehicle_id"]}
FACTS = tuple(name for name in CORE_TABLES if name not in DIMENSIONS)
# Facts that later batches are held against, and the key that is looked up.
LOOKED_UP = {"sales_orders": "order_id", "purchase_orders": "purchase_order_id",
             "inventory_snapshots": "snapshot_date", "expeditions": "order_id"}
BUCKETS = 64


class InputRejected(ValueError):
    """The sheets break their contract or a business check; ``verdict`` has the counts."""

    def __init__(self, verdict: dict):
        super().__init__(f"input rejected: {json.dumps(verdict)}")
        self.verdict = verdict


class ConstraintBroken(RuntimeError):
    """Rows that no table of the store may hold."""


class Store:
    """Paths and readers of one warehouse folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _read(self, path: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._read(self.path("audit", "events"), audit.EVENT_SCHEMA)

    def batches(self) -> DataFrame:
        return audit.batches(self.events())

    def append_event(self, *args, **values) -> None:
        audit.event(self.spark, *args, **values).coalesce(1).write.mode("append").parquet(
            self.path("audit", "events"))

    def raw(self, batch_id: str) -> DataFrame:
        return landing.read_raw(self.spark, self.path("raw"), batch_id)

    def staged(self, batch_id: str) -> Sheets:
        def one(sheet: str) -> DataFrame:
            rows = self.spark.read.schema(staging_schema(sheet)).parquet(
                self.path("staging", sheet))
            return rows.where(F.col("import_batch_id") == batch_id)
        return Sheets(**{s: (lambda s=s: one(s)) for s in SHEETS})

    def issues(self) -> DataFrame:
        schema = T.StructType(ISSUE_SCHEMA.fields + [
            T.StructField("import_batch_id", T.StringType())])
        return self._read(self.path("audit", "issues"), schema)

    def completed(self) -> list[str]:
        """Batches that count, in their order: one entry an import."""
        rows = self.batches().where("status = 'completed'").orderBy("batch_seq").select("batch_id").collect()
        return [r.batch_id for r in rows]

    def newest(self) -> int | None:
        """Sequence of the newest completed batch: the version of the dimensions."""
        return self.batches().where("status = 'completed'").agg(F.max("batch_seq").alias("s")).first().s

    def core(self, batch_ids: list[str] | None = None, version: int | None = None) -> Core | None:
        """Core tables of the completed batches; None before the first one.

        ``batch_ids``: facts of these batches alone; ``version``: dimensions as of that batch.
        """
        version = self.newest() if version is None else version
        if version is None:
            return None
        done = self.batches().where("status = 'completed'").select(F.col("batch_id").alias("source_import_batch_id"))

        def fact(name: str) -> DataFrame:
            rows = self.spark.read.parquet(self.path("core", name))
            if batch_ids is not None:   # folders of other batches are not read
                return rows.where(F.col("source_import_batch_id").isin(batch_ids))
            return rows.join(done, "source_import_batch_id", "left_semi")

        def dimension(name: str) -> DataFrame:
            return self.spark.read.parquet(self.path("core", name, f"version={version}"))

        return Core(**{
            **{n: (lambda n=n: fact(n)) for n in FACTS},
            **{n: (lambda n=n: dimension(n)) for n in DIMENSIONS}})


    # Keys of the looked-up facts are kept a second time, bucketed by key: joining a batch to them shuffles the batch alone.

    def _keys_table(self, name: str) -> str:
        """The catalogue entry, in this session, of the folder with a table's keys."""
        key = LOOKED_UP[name]
        table = f"keys_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{name}"
        kind = "date" if key == "snapshot_date" else "string"
        self.spark.sql(
            f"create table if not exists {table} ({key} {kind}, source_import_batch_id string) using parquet "
            f"clustered by ({key}) sorted by ({key}) into {BUCKETS} buckets location '{self.path('core_keys', name)}'")
        self.spark.catalog.refreshTable(table)
        return table

    def add_keys(self, name: str, rows: DataFrame) -> None:
        """Append the keys of a batch; they count once the batch is completed, and may come twice."""
        rows.select(LOOKED_UP[name], "source_import_batch_id").distinct().write.insertInto(self._keys_table(name))

    def keys(self, name: str) -> DataFrame:
        """Keys of the completed batches, one row each; read by bucket."""
        done = self.completed()
        if done and self.spark.table(self._keys_table(name)).isEmpty():     # a store of before there were keys
            self.add_keys(name, getattr(self.core(), name))
        return self.spark.table(self._keys_table(name)).where(
            F.col("source_import_batch_id").isin(done)).select(LOOKED_UP[name]).distinct()

    def loaded(self) -> Core | None:
        """The core as far as rules look into it: keys of the looked-up facts."""
        core = self.core()
        return None if core is None else core.replace(**{n: (lambda n=n: self.keys(n)) for n in LOOKED_UP})


def _overwrite(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions ``df`` has."""
    df.write.partitionBy(partition).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def check_input(sheets: dict[str, DataFrame], entries: list[contract.ContractColumn] | None = None
                ) -> dict[str, object]:
    """Structure, then values, then business checks; a step with errors is the last one done.

    Sheets of text alone are read as cells of a text file.
    """
    entries = entries or contract.default_contract()
    found = contract.structure({n: _data_columns(df) for n, df in sheets.items()}, entries)
    different = {e["sheet"]: e["status"] for e in found if e["status"] != "OK"}
    verdict: dict[str, object] = {"step": "structure", "error_count": len(different), "warning_count": 0}
    if different:
        return verdict | {"sheets": different}

    def textual(df: DataFrame) -> bool:
        return all(isinstance(f.dataType, T.StringType) for f in df.schema.fields if f.name != "source_row_number")

    def counted(step: str, issues: DataFrame, once: Column | None = None) -> None:
        rows = contract.counted_issues(issues, once).collect()   # one row a code
        verdict["step"] = step
        verdict[step] = {r.code: r.issue_count for r in sorted(rows, key=lambda r: r.code)}
        for level, name in (("ERROR", "error_count"), ("WARNING", "warning_count")):
            verdict[name] += sum(r.issue_count for r in rows if r.level == level)

    counted("values", reduce(DataFrame.unionByName, [
        contract.value_issues(df, n, entries, from_text=textual(df)).select("level", "code")
        for n, df in sheets.items()]))
    if verdict["error_count"]:
        return verdict
    typed = Sheets(**{n: (lambda n=n: sheets[n].select("source_row_number", *[
        staging.tried(F.col(c).cast("string"), declared).alias(c) for c, declared, _ in SHEETS[n]])) for n in SHEETS})
    counted("business", sheet_rules.all_findings(typed), sheet_rules.counted_once())
    return verdict


def staging_violations(sheets: Sheets) -> DataFrame:
    """``table_name, rule, columns, violations``: repeated keys and missing values of staged sheets, if any."""
    parts = []
    for name, df in sheets.items():
        required = [c for c, _, nullable in SHEETS[name] if not nullable]
        nulls = audit.null_counts(df, required)
        parts.append(nulls.select(F.explode(F.array(*[F.struct(
            F.lit(name).alias("table_name"), F.lit("not null").alias("rule"), F.lit(c).alias("columns"),
            F.col(c).cast("bigint").alias("violations")) for c in required])).alias("v")).select("v.*"))
        if name in SHEET_KEYS:
            keys = SHEET_KEYS[name]
            parts.append(audit.key_violations(df, keys).agg(F.count("*").alias("violations")).select(
                F.lit(name).alias("table_name"), F.lit("unique").alias("rule"),
                F.lit(",".join(keys)).alias("columns"), "violations"))
    return reduce(DataFrame.unionByName, parts).where("violations > 0")


def core_violations(new: Core, known: Core, loaded: Core | None = None) -> DataFrame:
    """``table_name, rule, columns, violations``: repeated keys of ``new`` rows and references that ``known`` lacks.

    What ``known`` lacks of the looked-up keys may be in ``loaded``.
    """
    parts = []
    for name, keys in CORE_KEYS.items():
        parts.append(audit.key_violations(getattr(new, name), keys).agg(F.count("*").alias("violations")).select(
            F.lit(name).alias("table_name"), F.lit("unique").alias("rule"), F.lit(",".join(keys)).alias("columns"), "violations"))
    for child, column, parent, parent_column in CORE_REFERENCES:
        missing = audit.reference_violations(getattr(new, child), column, getattr(known, parent), parent_column)
        if loaded is not None and LOOKED_UP.get(parent) == parent_column:
            missing = audit.reference_violations(missing, column, getattr(loaded, parent), parent_column)
        parts.append(missing
                     .agg(F.count("*").alias("violations")).select(
            F.lit(child).alias("table_name"), F.lit("reference").alias("rule"), F.lit(column).alias("columns"), "violations"))
    return reduce(DataFrame.unionByName, parts).where("violations > 0")


def _refuse(violations: DataFrame) -> None:
    """A bounded list: one row a rule that is broken."""
    broken = violations.collect()
    if broken:
        raise ConstraintBroken("; ".join(f"{r.table_name} {r.rule} {r.columns}: {r.violations}" for r in broken))


def register(store: Store, file_sha256: str, **details) -> tuple[str, str, bool]:
    """(batch id, status, known before): the content hash is the identity of a batch."""
    sha = file_sha256.lower()
    known = store.batches().where(F.col("file_sha256") == sha).select("batch_id", "status").first()
    if known is not None:
        return known.batch_id, known.status, True
    batch_id = str(uuid.uuid4())
    top = store.batches().agg(F.coalesce(F.max("batch_seq"), F.lit(0)).alias("s")).first().s
    store.append_event(batch_id, 0, "registered", batch_seq=top + 1, file_sha256=sha, **details)
    return batch_id, "registered", False


def load_raw(store: Store, batch_id: str, sheets: dict[str, DataFrame]) -> int:
    """Land every sheet; returns the number of raw rows."""
    headers = {name: _data_columns(sheets[name]) for name in SHEETS}
    store.append_event(batch_id, 1, "validating",
                       metadata={"sheet_headers": json.dumps(headers)})
    for name in SHEETS:
        landed = landing.land_rows(sheets[name], name, batch_id)
        landed.write.partitionBy("import_batch_id", "sheet").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(store.path("raw"))
    counts = {r.sheet: r.n for r in store.raw(batch_id).groupBy("sheet").agg(
        F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    store.append_event(batch_id, 2, "raw_loaded", row_count_raw=total,
                       metadata={"sheet_row_counts": json.dumps(counts)})
    return total


def load_staging(store: Store, batch_id: str) -> int:
    """Type the raw rows; all of them must arrive."""
    raw = store.raw(batch_id)
    typed = staging.stage_all(raw)
    for name, df in typed.items():
        _overwrite(df, store.path("staging", name), "import_batch_id")
    report = staging.completeness(raw, store.staged(batch_id)).collect()
    if not all(row.complete for row in report):
        raise RuntimeError("staging rows differ from raw rows")
    _refuse(staging_violations(store.staged(batch_id)))
    total = sum(row.staging_rows for row in report)
    store.append_event(batch_id, 3, "staging_loaded", metadata={
        "staging_row_counts": json.dumps({r.sheet: r.staging_rows for r in report})})
    return total


def validate(store: Store, batch_id: str) -> dict[str, int]:
    """Write the batch's issues (replacing earlier ones), count them per rule."""
    found = rules.all_issues(store.staged(batch_id), store.loaded())
    path = store.path("audit", "issues", f"import_batch_id={batch_id}")
    found.hint("rebalance").write.mode("overwrite").parquet(path)
    counts = store.spark.read.parquet(path).groupBy("rule_code").agg(
        F.count("*").alias("n")).collect()
    return {row.rule_code: row.n for row in sorted(counts)}


def promote(store: Store, batch_id: str, batch_seq: int) -> dict[str, int]:
    """Next version of the dimensions, then the facts of the batch."""
    sheets, old, loaded, spark = store.staged(batch_id), store.core(), store.loaded(), store.spark
    counts: dict[str, int] = {}

    def added(name: str) -> DataFrame:
        if name in DIMENSIONS:
            return spark.read.parquet(store.path("core", name, f"version={batch_seq}"))
        return spark.read.parquet(store.path("core", name)).where(F.col("source_import_batch_id") == batch_id)

    def dimension(name: str, incoming: DataFrame) -> DataFrame:
        path = store.path("core", name, f"version={batch_seq}")
        rows = core_load.stamped(incoming)
        if old is not None:
            rows = upsert(getattr(old, name), rows, DIMENSIONS[name])
        rows.write.mode("overwrite").parquet(path)
        result = spark.read.parquet(path)
        counts[name] = result.where(F.col("source_import_batch_id") == batch_id).count()
        return result

    def fact(name: str, rows: DataFrame) -> None:
        path = store.path("core", name)
        _overwrite(rows, path, "source_import_batch_id")
        if name in LOOKED_UP:
            store.add_keys(name, added(name))
        counts[name] = spark.read.parquet(path).where(
            F.col("source_import_batch_id") == batch_id).count()

    suppliers = dimension("suppliers", core_load.suppliers(
        sheets, None if old is None else old.suppliers, batch_id))
    dimension("customers", core_load.customers(sheets, batch_id))
    dimension("products", core_load.products(sheets, suppliers))
    dimension("vehicles", core_load.vehicles(sheets))
    fact("sales_orders", core_load.sales_orders(sheets))
    fact("sales_order_lines", core_load.sales_order_lines(sheets))
    fact("purchase_orders", core_load.purchase_orders(sheets, suppliers))
    fact("purchase_order_lines", core_load.purchase_order_lines(sheets, batch_seq))
    fact("inventory_snapshots", core_load.inventory_snapshots(sheets))
    fact("inventory_snapshot_lines", core_load.inventory_snapshot_lines(sheets))
    fact("expeditions", core_load.expeditions(sheets))

    def whole(name: str) -> DataFrame:
        rows = added(name)
        keyed = LOOKED_UP.get(name) in {c for _, _, parent, c in CORE_REFERENCES if parent == name}
        return rows if old is None or name in DIMENSIONS or keyed else rows.unionByName(getattr(old, name))

    _refuse(core_violations(Core(**{n: (lambda n=n: added(n)) for n in CORE_TABLES}),
                            Core(**{n: (lambda n=n: whole(n)) for n in CORE_TABLES}), loaded))
    return counts


def load_core(store: Store, batch_id: str) -> str:
    """Promote a clean batch, reject one with any error; returns the new status."""
    seq = store.batches().where(F.col("batch_id") == batch_id).select("batch_seq").first()
    errors = validate(store, batch_id)
    if errors:
        verdict = {"status": "rejected", "rule_counts": errors}
        store.append_event(batch_id, 4, "rejected", error_count=sum(errors.values()),
                           metadata={"business_validation": json.dumps(verdict)})
        return "rejected"
    counts = promote(store, batch_id, seq.batch_seq)
    verdict = {"status": "passed", "error_count": 0}
    store.append_event(
        batch_id, 4, "completed", error_count=0, row_count_core=sum(counts.values()),
        metadata={"business_validation": json.dumps(verdict),
                  "core_row_counts": json.dumps(counts)})
    return "completed"


def finalize(store: Store, batch_id: str) -> str:
    """Write the report of a finished batch; rows per layer and table go to its metadata.

    Returns the folder of the report (one JSON document).  It may be repeated.
    """
    raw, staged, core = store.raw(batch_id), store.staged(batch_id), store.core()
    layers = {"raw": {"excel_rows": (raw, "import_batch_id")},
              "staging": {n: (df, "import_batch_id") for n, df in staged.items()},
              "core": {} if core is None else {
                  n: (getattr(core, n).where(F.col("source_import_batch_id") == batch_id), "source_import_batch_id")
                  for n in FACTS}}
    counts = audit.layer_counts({k: v for k, v in layers.items() if v})
    rows = counts.collect()     # one row a table and layer
    totals = {r.layer: r.row_count for r in rows if r.table is None}
    tables = {f"{r.layer}.{r.table}": r.row_count for r in rows if r.table is not None}
    store.append_event(batch_id, 6, store.batches().where(F.col("batch_id") == batch_id).first().status,
                       metadata={"layer_totals": json.dumps(totals), "layer_row_counts": json.dumps(tables)})
    path = store.path("audit", "reports", f"import_batch_id={batch_id}")
    record = store.batches().where(F.col("batch_id") == batch_id)
    issues = store.issues().where(F.col("import_batch_id") == batch_id)
    audit.batch_report(record, counts, issues).select("report").coalesce(1).write.mode("overwrite").text(path)
    return path


def import_sheets(store: Store, sheets: dict[str, DataFrame], file_sha256: str, gate: bool = True,
                  **details) -> tuple[str, str]:
    """Run or resume a batch; returns (batch id, status).

    A known content is not loaded again; an interrupted batch goes on from its last good step.
    A new one is checked first (``gate``): with any error nothing is registered.  What the gate
    lets pass still has to hold the constraints of staging and core.
    """
    for name in SHEETS:
        landing.guard_header(name, _data_columns(sheets[name]))
    known = not store.batches().where(F.col("file_sha256") == file_sha256.lower()).isEmpty()
    if gate and not known:
        verdict = check_input(sheets)
        if verdict["error_count"]:
            raise InputRejected(verdict)
        details = {"warning_count": verdict["warning_count"], **details,
                   "metadata": {"input_checks": json.dumps(verdict), **details.get("metadata", {})}}
    batch_id, status, _ = register(store, file_sha256, **details)
    if status in ("registered", "validating"):
        _or_failed(store, batch_id, lambda: load_raw(store, batch_id, sheets))
        status = "raw_loaded"
    if status == "raw_loaded":
        load_staging(store, batch_id)
        status = "staging_loaded"
    if status == "staging_loaded":
        status = _or_failed(store, batch_id, lambda: load_core(store, batch_id))
        finalize(store, batch_id)
    return batch_id, status


def import_files(store: Store, files: dict[str, str], fmt: str = "csv", gate: bool = True, multi_line: bool = True,
                 **details) -> tuple[str, str]:
    """Import sheet files (sheet -> path): the batch is known by the content of all of them.

    Content that a batch has seen is not read again.
    """
    prints = landing.fingerprints(store.spark, sorted(files.values()))
    sizes = prints.agg(F.sum("file_size_bytes").alias("n")).first().n
    sheets = {name: landing.read_sheet(store.spark, path, fmt, multi_line=multi_line and fmt == "csv")
              for name, path in files.items()}
    return import_sheets(store, sheets, landing.content_hash(prints), gate, file_size_bytes=sizes, **details)


def _or_failed(store: Store, batch_id: str, step):
    """Run a step; an error ends the batch (a staging error does not: it can be repeated)."""
    try:
        return step()
    except Exception as error:
        store.append_event(batch_id, 5, "failed", error_message=str(error))
        raise


def _data_columns(sheet: DataFrame) -> list[str]:
    return [c for c in sheet.columns if c != "source_row_number"]
