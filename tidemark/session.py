"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings that the plans rely on.  They only steer the optimizer: results do not depend on
# them, apart from the time zone and the map merge policy.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sizes are compared as Spark knows them, compressed; as a hash relation keys take 40 times as much, and the driver builds
    # all relations of a query at once: only small tables, not order headers or keys, are sent to every executor.
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
    # The text of a plan is kept by the driver, and made anew each time a stage of it ends; whole texts of large plans fill its memory.
    "spark.sql.maxPlanStringLength": "20000",
    # Longer methods are not compiled by the JVM: a sheet's checks then run outside whole-stage code, in short ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


_REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES, _OPEN = threading.Lock(), [0]
_LOCAL_DIRS: dict[str, str] = {}
_WORK: ContextVar[str | None] = ContextVar("work_folder", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  app_name: str = "tidemark") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is made only on a local master, where every task shares the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_DIRS[application]


@contextmanager
def work_folder(spark: SparkSession, folder: str):
    """Meanwhile ``written`` uses ``folder`` (in this thread), which is deleted at the end: whoever opens
    it must have stored its results by then."""
    token = _WORK.set(folder)
    try:
        yield
    finally:
        _WORK.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written meanwhile go when it is written, not when the driver's heap happens to be collected."""
    with _WRITES:
        _OPEN[0] += 1
        spark.conf.set(_REMOVE, "true")
    try:
        yield
    finally:
        with _WRITES:  # another thread may be writing
            _OPEN[0] -= 1
            if not _OPEN[0]:
                spark.conf.unset(_REMOVE)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where several plans consume one expensive intermediate result: the lineage is cut,
    a lost executor re-reads files instead of recomputing, and readers still prune columns.
    """
    spark = df.sparkSession
    folder = _WORK.get() or f"{shared_dir(spark)}/tidemark"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
