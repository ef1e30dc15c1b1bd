"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the next step then needs a shuffle of its own
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keeps streaming state off the heap, so it may outgrow executor memory
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "featloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the results depend on; `extra` uses `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere.

    All date arithmetic is defined in UTC, and hot join keys must be split.
    """
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, SETTINGS[key])
    return spark


#: Scratch folders that this process made and has not cleared.
_MADE: list[str] = []
#: Folders that were found to be shared, by application.
_TRIED: set[tuple[str, str]] = set()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for stream checkpoints, sink tables and written stages, which all machines see.

    It lies under `spark.checkpoint.dir`, else under the warehouse. A `file:` path may be one machine's own disk or
    a folder mounted on all of them, so where executors may run on other machines it is tried once, and refused
    if the driver misses a file that a task wrote there.
    """
    shared = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{shared}/featloom-{purpose}-{uuid.uuid4().hex}"
    app = (spark.sparkContext.applicationId, shared)
    if app not in _TRIED and not spark.sparkContext.master.startswith("local") and _on_local_disk(spark, path):
        if not _shared(spark, shared):
            raise ValueError(f"{shared} is a local folder; set spark.checkpoint.dir to one that all machines share")
        _TRIED.add(app)
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders made so far, once no frame or stream reads them any more; gives their number."""
    cleared = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        cleared += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return cleared


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to a scratch folder and read again, for what several parts of a plan need."""
    path = scratch_dir(df.sparkSession, purpose)
    filled = [f.name for f in df.schema if f.dataType != T.NullType()]  # Parquet has no column without a type
    df.select(*[F.col(f"`{c}`") for c in filled]).write.parquet(path)
    back = df.sparkSession.read.schema(T.StructType([df.schema[c] for c in filled])).parquet(path)
    return back if len(filled) == len(df.columns) else back.select(*[F.col(f"`{c}`") if c in filled else F.lit(None).alias(c) for c in df.columns])


def _on_local_disk(spark: SparkSession, path: str) -> bool:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    scheme = urlparse(path).scheme or urlparse(conf.get("fs.defaultFS", "file:///")).scheme
    return scheme == "file"


def _shared(spark: SparkSession, folder: str) -> bool:
    """Whether the driver finds the files of all tasks that write to a folder."""
    tried, tasks = f"{folder}/featloom-tried-{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).write.parquet(tried)
    found = len(spark.read.schema("id bigint").parquet(tried).inputFiles())
    path = spark._jvm.org.apache.hadoop.fs.Path(tried)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return found == tasks
