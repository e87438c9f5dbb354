"""Landing: sheet files to raw JSON rows, one batch per distinct file content."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import RAW_SCHEMA

FIRST_DATA_ROW = 2


class BadHeader(ValueError):
    """A sheet header is blank or repeated."""


def guard_header(sheet: str, header: list[str | None]) -> None:
    """Reject blank or repeated column names (metadata only, no job)."""
    if not header or any(name is None or str(name) == "" for name in header):
        raise BadHeader(f"sheet {sheet!r} has a blank header")
    repeated = sorted(name for name, n in Counter(header).items() if n > 1)
    if repeated:
        raise BadHeader(f"sheet {sheet!r} repeats headers {repeated}")


def read_sheet(spark: SparkSession, path: str, fmt: str = "csv",
               schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Open a sheet as CSV (header in the first line), JSON lines, Parquet or ORC.

    Adds ``source_row_number`` unless the input carries one.  CSV without a schema is text, as the
    contract checks of text sheets want it (``value_issues(..., from_text=True)``); with a schema a
    value that does not fit fails the read instead of becoming null.  ``multi_line``: cells may hold
    line breaks (a JSON file of that kind is read by one task, a CSV file by as many as it has splits).
    """
    if fmt == "csv" and multi_line:
        return read_multi_line_csv(spark, path, schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt in ("csv", "json"):
        reader = reader.option("multiLine", multi_line)
        if schema is not None:
            reader = reader.option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    sheet = reader.format(fmt).load(path)
    if "source_row_number" in sheet.columns:
        return sheet
    return numbered_by_position(sheet) if fmt == "parquet" else _numbered(sheet)


def _numbered(sheet: DataFrame) -> DataFrame:
    """Number rows by their place in the files (in path order), data starting at row 2.

    A task reads a file split in order, so rows are ranked inside their split only (no task
    ranks more than one split); one row per split, cumulated, gives the offset.
    """
    columns = sheet.columns
    placed = sheet.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_seq"))
    earlier = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_file", "_split").agg(F.count("*").alias("_n"))
        .select("_file", "_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    )
    position = F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_seq"))
    return (
        placed.join(offsets, ["_file", "_split"])
        .withColumn("source_row_number", position + F.col("_o") + FIRST_DATA_ROW - 1)
        .select("source_row_number", *columns)
    )


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text``: records of CSV files whose quoted cells may hold line breaks; 0 is the header.

    Whether a line begins a record depends on the number of quotes before it.  Inside a split it is counted
    from the split's begin, for both cases at once; one row a split, cumulated, then tells which case
    holds and how many records came before.  Only lines of records of several lines are shuffled.
    """
    # The metadata has no place for a line in its file, but ids grow within a split.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), "value",
        (F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    split = Window.partitionBy("file", "split").orderBy("seq")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    upto = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = F.col("value").isin("", "\r")
    placed = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    cases = [F.sum(((F.col("odd") == case) & ~blank).cast("int")) for case in (0, 1)]
    placed = placed.select("*", *[cases[case].over(upto).alias(f"r{case}") for case in (0, 1)])
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        placed.groupBy("file", "split").agg(F.sum("quotes").alias("q"), cases[0].alias("n0"), cases[1].alias("n1"))
        .withColumn("case", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
        .withColumn("n", F.when(F.col("case") == 0, F.col("n0")).otherwise(F.col("n1")))
        .select("file", "split", "case", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    begins = F.col("odd") == F.col("case")
    numbered = placed.join(splits, ["file", "split"]).select(
        "file", "split", "seq", "value", begins.alias("begins"), (begins & (F.col("quotes") % 2 == 0)).alias("whole"),
        (F.col("base") + F.when(F.col("case") == 0, F.col("r0")).otherwise(F.col("r1")) - 1).alias("record"), blank.alias("blank"))
    whole = numbered.where("whole and not blank").select("file", "record", F.col("value").alias("text"))
    parts = numbered.where("not whole").groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("split", "seq", "value"))).alias("lines"))
    broken = parts.select("file", "record", F.array_join(F.col("lines.value"), "\n").alias("text"))
    return whole.unionByName(broken).withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_multi_line_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with line breaks in cells, on as many tasks as the files have splits; rows numbered as by ``read_sheet``."""
    options = {"escape": '"', "multiLine": "true"}
    if schema is None:
        header = spark.read.options(header=True, **options).csv(path).columns
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    else:
        options["mode"] = "FAILFAST"
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    records = _records(spark, path)
    sizes = records.groupBy("file").agg((F.max("record")).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    cells = F.from_csv("text", declared, options)
    return records.where("record > 0").join(offsets, "file").select(
        (F.col("record") + F.col("offset") + FIRST_DATA_ROW - 1).alias("source_row_number"), cells.alias("c")).select(
        "source_row_number", "c.*")


def header_problems(headers: DataFrame) -> DataFrame:
    """S02 as a table: ``sheet, name, n`` of blank or repeated names among (sheet, name) rows."""
    name = F.coalesce(F.col("name").cast("string"), F.lit(""))
    return headers.groupBy("sheet", name.alias("name")).agg(F.count("*").alias("n")).where("n > 1 or name = ''")


def numbered_by_position(sheet: DataFrame, first_rows: int | None = None) -> DataFrame:
    """The same for Parquet, which knows the position of a row in its file: no ranking.

    ``first_rows``: only rows that may be among the first so many are read and joined.
    """
    columns = sheet.columns
    placed = sheet.select("*", F.col("_metadata.file_path").alias("_file"),
                          F.col("_metadata.row_index").alias("_index"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sheet.select(F.col("_metadata.file_path").alias("_file"))
        .groupBy("_file").agg(F.count("*").alias("_n"))
        .select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    )
    if first_rows is not None:
        placed = placed.where(F.col("_index") < first_rows)
    # One row a file.  Joined by a shuffle, all rows of a file would come to one task.
    return placed.join(F.broadcast(offsets), "_file").select(
        (F.col("_index") + F.col("_o") + FIRST_DATA_ROW).alias("source_row_number"), *columns)


def json_value(field: T.StructField) -> Column:
    """Cell as it is kept in raw rows: dates as ISO text, decimals as text, the rest as is."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(field.dataType, T.DecimalType):
        return column.cast("string")
    return column


def land_rows(sheet: DataFrame, name: str, batch_id: str) -> DataFrame:
    """Raw rows of one sheet; rows without any value are dropped, row numbers kept."""
    fields = [f for f in sheet.schema.fields if f.name != "source_row_number"]
    guard_header(name, [f.name for f in fields])
    cells = [F.col(f"`{f.name}`").cast("string") for f in fields]
    payload = F.to_json(
        F.struct(*[json_value(f).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})
    return sheet.where(F.coalesce(*cells).isNotNull()).select(
        F.lit(name).alias("sheet"), F.lit(batch_id).alias("import_batch_id"),
        F.col("source_row_number").cast("bigint").alias("source_row_number"),
        payload.alias("source_data"), F.current_timestamp().alias("loaded_at"))


def append_raw(raw: DataFrame, path: str) -> None:
    """Append, partitioned so that a batch or a sheet is a directory."""
    raw.write.partitionBy("import_batch_id", "sheet").mode("append").parquet(path)


def read_raw(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    raw = spark.read.schema(RAW_SCHEMA).parquet(path)
    return raw if batch_id is None else raw.where(F.col("import_batch_id") == batch_id)


# --- fixed values: endings of files that Spark's text reader unpacks -------------------------------
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
# -------------------------------------------------------------------------------------------------
_ONE_SPLIT = str(1 << 40)
_BYTE_ORDER_MARK = b"\xef\xbb\xbf"  # left out by the text reader where a file begins with it


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, file_sha256) of files whose lines come one after another, each file with its size."""
    path = size = marked = plain = None
    length = 0

    def done() -> pa.RecordBatch:
        missing = size - length
        digest = marked if missing >= len(_BYTE_ORDER_MARK) else plain
        missing -= len(_BYTE_ORDER_MARK) if digest is marked else 0
        if missing not in (0, 1):
            raise RuntimeError(f"{path} changed while it was read")
        digest.update(b"\n" * missing)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], names=["place", "file_sha256"])

    for batch in batches:
        at, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lines, begin = batch.column(2).to_pylist(), 0
        while begin < len(at):
            end = begin + 1
            while end < len(at) and at[end] == at[begin]:
                end += 1
            if at[begin] != path:
                if path is not None:
                    yield done()
                path, size, length = at[begin], sizes[begin], 0
                plain, marked = hashlib.sha256(), hashlib.sha256(_BYTE_ORDER_MARK)
                chunk = b"\n".join(lines[begin:end])
            else:
                chunk = b"\n" + b"\n".join(lines[begin:end])
            plain.update(chunk)
            marked.update(chunk)
            length += len(chunk)
            begin = end
    if path is not None:
        yield done()


def fingerprints(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, file_sha256, file_size_bytes) of the complete content of each file.

    A file is one split, so one task, which takes its lines as they are read: memory is bounded by the longest
    line.  Files that the reader would unpack are read as one value.
    """
    apart = spark.newSession()  # with its own split size
    apart.conf.set("spark.sql.files.maxPartitionBytes", _ONE_SPLIT)
    apart.conf.set("spark.sql.files.openCostInBytes", _ONE_SPLIT)
    place = F.col("_metadata.file_path").alias("place")
    packed = F.col("place").rlike(PACKED)
    opened = apart.read.format("binaryFile").load(paths)
    files = opened.select("path", place, F.col("length").alias("file_size_bytes"), "content")
    # A scan passes over files without content: they are known from the listing alone.
    listing = apart.createDataFrame([(name,) for name in opened.inputFiles()], "place string").select(
        F.regexp_replace("place", "^([a-zA-Z]+):///", "$1:/").alias("place"))
    lines = apart.read.option("lineSep", "\n").text(paths).select(
        place, F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    plain = lines.where(~packed).mapInArrow(_digests, "place string, file_sha256 string")
    # A file of which no line comes has nothing in it, or the mark alone.
    empty = F.when(F.col("file_size_bytes") == len(_BYTE_ORDER_MARK), hashlib.sha256(_BYTE_ORDER_MARK).hexdigest()).otherwise(
        hashlib.sha256().hexdigest())
    listed = listing.where(~packed).join(files.select("place", "path", "file_size_bytes"), "place", "left").join(plain, "place", "left")
    return listed.select(
        F.coalesce("path", "place").alias("path"), F.coalesce("file_sha256", empty).alias("file_sha256"),
        F.coalesce("file_size_bytes", F.lit(0)).alias("file_size_bytes")).unionByName(
        files.where(packed).select("path", F.sha2("content", 256).alias("file_sha256"), "file_size_bytes"))


def content_hash(files: DataFrame) -> str:
    """One hash of a set of files, whatever their names: the hash of their sorted hashes."""
    rows = files.select("file_sha256").collect()   # one row a file of the import
    return rows[0].file_sha256 if len(rows) == 1 else hashlib.sha256(
        "\n".join(sorted(r.file_sha256 for r in rows)).encode()).hexdigest()


def new_files(files: DataFrame, batches: DataFrame) -> DataFrame:
    """One file per content that no batch has seen (the smallest path of equal files)."""
    return (
        files.join(batches.select("file_sha256"), "file_sha256", "left_anti")
        .groupBy("file_sha256")
        .agg(F.min("path").alias("path"), F.first("file_size_bytes").alias("file_size_bytes"))
    )
