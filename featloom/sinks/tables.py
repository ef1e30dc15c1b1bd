"""Outputs of streams and batches.

A keyed stream output is kept as one folder per micro-batch. A repeated batch
replaces its own folder, so delivery twice changes nothing, and no batch rewrites
what earlier ones wrote. Readers take the latest batch per key, starting from the last compaction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from featloom.operators.latest import latest_by_key
from featloom.sinks.keyed import KeyedTable


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update",
          available_now: bool = False, every: str | None = None, name: str | None = None) -> StreamingQuery:
    writer = (df.writeStream.foreachBatch(handle).outputMode(mode)
              .option("checkpointLocation", checkpoint))
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def upsert_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "update",
                  **trigger) -> StreamingQuery:
    """A keyed stream output; read it back with `current`."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write_batch(batch, batch_id, path)
    return start(df, handle, checkpoint, mode, **trigger)


def keyed_stream(df: DataFrame, table: KeyedTable, job: str, checkpoint: str, mode: str = "update",
                 compact_every: int | None = None, reduce: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """A stream's rows laid over a keyed table; a batch that is repeated changes nothing.

    Every so many batches the buckets with many folders are rewritten. `reduce` makes one row per key of the rows of a batch;
    such a stream has no state but the table.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        if table.holds(job, batch_id):
            if not reduce:
                batch.write.format("noop").mode("overwrite").save()  # the state of a repeated batch has to be written all the same
        elif reduce:
            table.write(reduce(batch), job=job, batch=batch_id, reduced=True)
        else:
            table.write(batch, job=job, batch=batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(compact_every)
    return start(df, handle, checkpoint, mode, **trigger)


def _merged(path: str) -> str:
    return path.rstrip("/") + "-compacted"


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete folders `name=<number>` below a path, in order."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        folder = status.getPath()
        if folder.getName().startswith(f"{name}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found.append(int(folder.getName().split("=", 1)[1]))
    return sorted(found)


def _batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows with their `batch_id`: the newest compaction and the batches after it."""
    merged = _folders(spark, _merged(path), "upto")
    upto = merged[-1] if merged else None
    later = [i for i in _folders(spark, path, "batch_id") if upto is None or i > upto]
    parts = [spark.read.parquet(f"{_merged(path)}/upto={upto}")] if merged else []
    if later:
        parts.append(spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={i}" for i in later])
                     .withColumn("batch_id", F.col("batch_id").cast("bigint")))
    if not parts:
        if schema is None:
            raise ValueError(f"no batch was written to {path} yet; give a schema to read it as empty")
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("bigint"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def current(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The latest state per key of an `upsert_stream` output; empty with `schema` before the first batch."""
    return latest_by_key(_batches(spark, path, schema), keys, ["batch_id"]).drop("batch_id")


def appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def compact_batches(spark: SparkSession, path: str, keys: Sequence[str]) -> int | None:
    """Write the latest row per key of all complete batches beside them; gives the last batch that it holds.

    The stream may go on meanwhile. Rows keep the `batch_id` they came with, and readers
    take the newest complete compaction and the batches after it.
    """
    done = _folders(spark, path, "batch_id")
    merged = _folders(spark, _merged(path), "upto")
    if not done or (merged and merged[-1] >= done[-1]):
        return merged[-1] if merged else None
    rows = _batches(spark, path).filter(F.col("batch_id") <= done[-1])
    latest_by_key(rows, keys, ["batch_id"]).write.mode("overwrite").parquet(f"{_merged(path)}/upto={done[-1]}")
    return done[-1]


def records_stream(df: DataFrame, fmt: str, checkpoint: str, topic: str | None = None,
                   available_now: bool = False, **options: str) -> StreamingQuery:
    """(key, value) records to a broker topic or to files."""
    writer = (df.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint).options(**options))
    if topic:
        writer = writer.option("topic", topic)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", partitions: int = 16,
               **properties: str) -> None:
    """Rows to a database table over a bounded number of connections.

    The rows are shuffled to that number, so that what computes them stays parallel.
    """
    df.repartition(partitions).write.jdbc(url, table, mode=mode, properties=properties)


def write_documents(docs: DataFrame, connect: Callable[[], object],
                    put: Callable[[object, list[Row]], None], batch_size: int = 1000) -> None:
    """Rows to an external store from the executors, `batch_size` at a time.

    `connect` opens a client once per partition; `put` must replace by key, since a
    task that is run again writes its rows again.
    """
    def send(rows: Iterator[Row]) -> None:
        client = connect()
        for chunk in _chunks(rows, batch_size):
            put(client, chunk)
    docs.foreachPartition(send)


def _chunks(rows: Iterable[Row], size: int) -> Iterator[list[Row]]:
    it = iter(rows)
    while chunk := list(islice(it, size)):
        yield chunk


def with_counts(df: DataFrame, name: str, **conditions: str):
    """`df` with row counts taken while it is written: (frame, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()]
    return df.observe(seen, *counts), seen
