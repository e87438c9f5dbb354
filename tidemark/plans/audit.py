"""Batch records: an append-only event log, its current state, counts and reports."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import BATCH_STATUSES, SEVERITIES, mart_limit
from tidemark.operators.findings import explode_where

EVENT_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType(), False),
    T.StructField("batch_seq", T.LongType()),
    T.StructField("event_seq", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("at", T.TimestampType(), False),
    T.StructField("file_sha256", T.StringType()),
    T.StructField("original_filename", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("row_count_raw", T.LongType()),
    T.StructField("row_count_core", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("warning_count", T.LongType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
# --- fixed values: step -> status it needs, statuses that end a batch -----------------------------
REQUIRED_STATUS = {"staging": "raw_loaded", "core": "staging_loaded", "finalize": "completed"}
FINISHED = ("completed", "rejected", "failed")
# --------------------------------------------------------------------------------------------------


def event(spark: SparkSession, batch_id: str, event_seq: int, status: str, **values) -> DataFrame:
    """One event row; a repeated write of the same step carries the same ``event_seq``."""
    if status not in BATCH_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    row = {f.name: None for f in EVENT_SCHEMA.fields}
    row.update(values, batch_id=batch_id, event_seq=event_seq, status=status,
               at=datetime.now(timezone.utc))
    return spark.createDataFrame([tuple(row[f.name] for f in EVENT_SCHEMA.fields)], EVENT_SCHEMA)


def merged(maps: Column) -> Column:
    """S08 in one row: an array of maps merged left to right, the later value wins."""
    return F.aggregate(maps, F.create_map().cast("map<string,string>"),
                       lambda before, later: F.map_concat(before, later))


def merged_metadata(events: DataFrame) -> DataFrame:
    """S08 over a log: per batch and key the value written last."""
    entries = events.select("batch_id", "event_seq", F.explode("metadata"))
    return (
        entries.groupBy("batch_id", "key")
        .agg(F.max_by("value", "event_seq").alias("value"))
        .groupBy("batch_id").agg(F.map_from_entries(F.sort_array(
            F.collect_list(F.struct("key", "value")))).alias("metadata"))
    )


def batches(events: DataFrame) -> DataFrame:
    """Current state per batch: the last status, the last known value of each column."""
    def latest(column: str) -> Column:
        known = F.when(F.col(column).isNotNull(), F.col("event_seq"))
        return F.max_by(column, known).alias(column)

    kept = [f.name for f in EVENT_SCHEMA.fields
            if f.name not in ("batch_id", "event_seq", "status", "at", "metadata")]
    finished = F.when(F.col("status").isin(*FINISHED), F.col("at"))
    state = events.groupBy("batch_id").agg(
        F.max_by("status", "event_seq").alias("status"), F.min("at").alias("started_at"),
        F.max(finished).alias("finished_at"), *[latest(c) for c in kept])
    return state.join(merged_metadata(events), "batch_id", "left")


def in_status(batch_table: DataFrame, step: str) -> DataFrame:
    """Batches a step may work on."""
    return batch_table.where(F.col("status") == REQUIRED_STATUS[step])


def sheet_row_counts(raw: DataFrame) -> DataFrame:
    """Sheet -> rows as one map per batch."""
    counts = raw.groupBy("import_batch_id", "sheet").agg(F.count("*").alias("n"))
    return counts.groupBy("import_batch_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sheet", "n"))))
        .alias("sheet_row_counts"))


def layer_counts(layers: dict[str, dict[str, tuple[DataFrame, str]]]) -> DataFrame:
    """Rows per (batch, layer, table) with totals per layer and batch (table is null).

    ``layers`` maps layer -> table -> (rows, name of the batch column).
    """
    parts = []
    for layer, tables in layers.items():
        for name, (df, batch_column) in tables.items():
            parts.append(
                df.groupBy(F.col(batch_column).alias("batch_id"))
                .agg(F.count("*").alias("n"))
                .select("batch_id", F.lit(layer).alias("layer"), F.lit(name).alias("table"), "n"))
    counts = reduce(DataFrame.unionByName, parts)
    return (
        counts.rollup("batch_id", "layer", "table").agg(F.sum("n").alias("row_count"))
        .where("layer is not null")
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues per severity and code, sorted."""
    return issues.groupBy("severity", "rule_code").agg(
        F.count("*").alias("issue_count")).orderBy("severity", "rule_code")


def pivoted(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen keys of a key/value table as columns of one row."""
    return pairs.where(F.col("key").isin(*keys)).agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def batch_listing(batch_table: DataFrame) -> DataFrame:
    """Batches, newest first."""
    return batch_table.select(
        "batch_id", "status", "original_filename", "row_count_raw", "row_count_core",
        "error_count", "warning_count", "started_at", "finished_at",
    ).orderBy(F.col("started_at").desc())


def batch_totals(batch_table: DataFrame) -> DataFrame:
    """Number of batches and their row totals."""
    return batch_table.agg(
        F.count("*").alias("batch_count"), F.sum("row_count_raw").alias("raw_rows"),
        F.sum("row_count_core").alias("core_rows"))


def batch_report(batch_table: DataFrame, counts: DataFrame, issues: DataFrame) -> DataFrame:
    """One JSON document per batch: its record, rows per layer and table, issue counts.

    Everything joined here is already reduced to a few rows per batch.
    """
    tables = counts.where("table is not null").groupBy("batch_id", "layer").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("table", "row_count"))))
        .alias("tables"), F.sum("row_count").alias("total"))
    layers = tables.groupBy("batch_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("layer", F.to_json(F.struct("tables", "total")).alias("j"))))).alias("layers"))
    summary = issues.groupBy("import_batch_id", "severity", "rule_code").agg(
        F.count("*").alias("count")).groupBy(F.col("import_batch_id").alias("batch_id")).agg(
        F.sort_array(F.collect_list(F.struct("severity", "rule_code", "count")))
        .alias("issues"))
    layer = lambda name: F.from_json(
        F.element_at(F.col("layers"), name), "tables map<string,bigint>, total bigint")
    rows = F.struct(*[layer(name).alias(name) for name in ("raw", "staging", "core")])
    return (
        batch_table.join(layers, "batch_id", "left").join(summary, "batch_id", "left")
        .select("batch_id", F.to_json(F.struct(
            F.struct(*batch_table.columns).alias("batch"), rows.alias("row_counts"),
            F.coalesce("issues", F.array().cast(
                "array<struct<severity:string,rule_code:string,count:bigint>>")).alias("issues"),
        )).alias("report"))
    )


# --- constraints as jobs (section on keys and references) -----------------------------------------

def key_violations(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Repeated keys of a table that must have unique ones."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def reference_violations(child: DataFrame, column: str, parent: DataFrame,
                         parent_column: str) -> DataFrame:
    """Child rows with a reference the parent does not have (missing references pass)."""
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column that must not have any, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def overflow_violations(mart: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``table_name, key, column_name, value, declared``: values of a mart beyond the type its contract declares.

    Marts are kept in wider types, so such a value is found as a row instead of ending the job.
    """
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    found = []
    for field in mart.schema.fields:
        declared = mart_limit(field)
        if declared and field.name not in keys:
            value = F.col(field.name)
            found.append((value.isNotNull() & value.try_cast(declared).isNull(), F.struct(
                F.lit(name).alias("table_name"), key.alias("key"), F.lit(field.name).alias("column_name"),
                value.cast("string").alias("value"), F.lit(declared).alias("declared"))))
    return explode_where(mart, found)


def batch_violations(batch_table: DataFrame) -> DataFrame:
    """Batches whose record breaks a domain rule."""
    sha = F.col("file_sha256").rlike("^[0-9a-f]{64}$")
    counted = reduce(Column.__and__, [
        F.coalesce(F.col(c), F.lit(0)) >= 0
        for c in ("row_count_raw", "row_count_core", "error_count", "warning_count")])
    ordered = F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("started_at"))
    known = F.col("status").isin(*BATCH_STATUSES)
    return batch_table.where(~(sha & counted & ordered & known))


def issue_violations(issues: DataFrame) -> DataFrame:
    """Issues with an unknown severity or a row number before the first data row."""
    row = F.col("source_row_number").isNull() | (F.col("source_row_number") >= 2)
    return issues.where(~(F.col("severity").isin(*SEVERITIES) & row))
