"""An append sink that writes every row once, as a data source of Spark's own interface.

A task writes its rows to a file of a name of its own and reports it. The driver names the files of a batch in one
entry of the log, which is there as a whole or not at all, and which a batch writes only once. Readers read the files
that the log names: what a task left that failed, was run twice or belongs to a repeated batch is not among
them. `df.writeStream.format("featloom_committed").option("path", ...)`, read back with `read`.

The folder may lie in any store that pyarrow knows (local, hdfs, s3, ...). Files without an entry can be
deleted by `sweep` while no writer runs.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

NAME = "featloom_committed"

# Spark's Python workers get the sink by value, so it runs where the package is not installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _store(path: str):
    """(file system, path in it)"""
    from pyarrow import fs
    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class CommittedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema, overwrite):
        return CommittedWriter(self.options["path"])


class CommittedWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        """One file for the rows of a task; none if it has no rows."""
        import pyarrow.parquet as pq
        store, root = _store(self.path)
        file, writer, rows = f"data/{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    store.create_dir(f"{root}/data", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{file}", batch.schema, filesystem=store)
                writer.write_batch(batch)
                rows += batch.num_rows
        if writer is not None:
            writer.close()
        return Written(file if writer else None, rows)

    def commit(self, messages, batchId: int) -> None:
        store, root = _store(self.path)
        store.create_dir(f"{root}/log", recursive=True)
        target = f"{root}/log/{batchId:020d}.json"
        if _exists(store, target):
            return  # the batch was committed, and what this attempt wrote stays unnamed
        draft = f"{root}/log/draft-{uuid.uuid4().hex}"
        told = {"batch": batchId, "files": sorted(m.file for m in messages if m and m.file), "rows": sum(m.rows for m in messages if m)}
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(told).encode())
        if type(store).__name__ == "LocalFileSystem":
            try:
                os.link(draft, target)  # fails if another writer's entry is there; a move would replace it
            finally:
                store.delete_file(draft)
        else:
            store.move(draft, target)

    def abort(self, messages, batchId: int) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m and m.file and _exists(store, f"{root}/{m.file}"):
                store.delete_file(f"{root}/{m.file}")


def _exists(store, path: str) -> bool:
    from pyarrow import fs
    return store.get_file_info(path).type != fs.FileType.NotFound


def _entries(path: str) -> list[dict]:
    from pyarrow import fs
    store, root = _store(path.rstrip("/"))
    if not _exists(store, f"{root}/log"):
        return []
    found = []
    for info in store.get_file_info(fs.FileSelector(f"{root}/log")):
        if info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as file:
                found.append(json.loads(file.read()))
    return sorted(found, key=lambda e: e["batch"])


def start(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    df.sparkSession.dataSource.register(CommittedSink)
    return (df.writeStream.format(NAME).option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**trigger or {"availableNow": True}).start())


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The committed rows; none before the first batch."""
    files = [f"{path.rstrip('/')}/{f}" for e in _entries(path) for f in e["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def sweep(path: str) -> int:
    """Delete the files that no entry names; gives their number. Not to be run beside a writer."""
    from pyarrow import fs
    store, root = _store(path.rstrip("/"))
    named, gone = {f for e in _entries(path) for f in e["files"]}, 0
    if _exists(store, f"{root}/data"):
        for info in store.get_file_info(fs.FileSelector(f"{root}/data")):
            if f"data/{info.base_name}" not in named:
                store.delete_file(info.path)
                gone += 1
    return gone
