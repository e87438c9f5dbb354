"""Helpers shared by the operators: safe columns, Arrow batches, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

# Rows and bytes in one Arrow batch: one of the longest texts still fits a small Python worker.
BATCH_ROWS = 512
BATCH_BYTES = "8m"

_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bytes_of(text: str) -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(quoted(text).cast("string"), F.lit("")).cast("binary")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputing.

    Inside ``collected`` the folder is noted, so that it can be deleted once nothing reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (folders := _SCOPE.get()) is not None:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders that ``saved`` writes meanwhile (in this thread)."""
    folders: list[str] = []
    token = _SCOPE.set(folders)
    try:
        yield folders
    finally:
        _SCOPE.reset(token)


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this package; ``held`` unpacks it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def held(sent: Broadcast):
    return cloudpickle.loads(sent.value)
