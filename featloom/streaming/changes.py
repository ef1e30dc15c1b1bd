"""Change-data stream applied to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from featloom.operators.latest import latest_by_key, top_n_by_key
from featloom.plans import changes as C
from featloom.sinks import tables as out
from featloom.sinks.keyed import KeyedTable


def start_apply(messages: DataFrame, row: T.StructType, keys: Sequence[str], path: str, checkpoint: str,
                order: Sequence[str] = C.ORDER, unwrapped: bool = False, rejects_path: str | None = None,
                **trigger) -> StreamingQuery:
    """Each micro-batch is reduced to its latest change per key before it is written.

    Messages that cannot be read go to `rejects_path`, if one is given.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        changes = C.flat(C.parse(batch, row, keys, unwrapped), row)
        out.write_batch(latest_by_key(changes, keys, order), batch_id, path)
        if rejects_path:
            out.write_batch(C.rejects(batch, row, keys, unwrapped), batch_id, rejects_path)
    return out.start(messages, handle, checkpoint, "append", **trigger)


def table(spark: SparkSession, path: str, base: DataFrame, keys: Sequence[str],
          order: Sequence[str] = C.ORDER) -> DataFrame:
    """The table as of the changes written so far; changes may arrive out of order."""
    return C.apply(base, spark.read.parquet(path).drop("batch_id"), keys, order)


#: Columns of a state table beside those of the row: the change that a row is from, and the last place of the log seen for its key.
STATE = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("offset", T.LongType()),
                      T.StructField("op", T.StringType()), T.StructField("seen", T.LongType())])


def state_table(spark: SparkSession, path: str, row: T.StructType, keys: Sequence[str], base: DataFrame | None = None,
                buckets: int = 16) -> KeyedTable:
    """A keyed table for `start_state`, which holds the rows of `base` at first.

    The table is the only state: of the changes of a key the latest one counts, whole rows decide what time and place leave
    open, and the last place seen is the greatest of all.
    """
    order = ("ts_ms", "offset", "op", *(c for c in row.names if c not in keys))
    table = KeyedTable.create(spark, path, T.StructType(row.fields + STATE.fields), keys, buckets, order, greatest=("seen",))
    if base is not None:
        rows = base.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in row.fields])
        rows = top_n_by_key(rows, keys, [F.to_json(F.struct(*row.names)).desc()], 1)
        table.write(rows.select(*row.names, *[F.lit(None).cast(f.dataType).alias(f.name) for f in STATE]), reduced=True)
    return table


def row_deltas(messages: DataFrame, row: T.StructType, keys: Sequence[str], unwrapped: bool = False) -> DataFrame:
    """Of a batch of messages: the latest change of every key that it names, and the last place seen in it.

    A change has an operation, empty if the message tells none, so that it comes after a row that no message changed.
    """
    changes = C.flat(C.parse(messages, row, keys, unwrapped), row)
    rest = [c for c in row.names if c not in keys]
    newest = F.max(F.struct("ts_ms", "offset", F.coalesce("op", F.lit("")).alias("op"), *rest)).alias("_c")
    return (changes.groupBy(*keys).agg(newest, F.max("offset").alias("seen"))
            .select(*[F.col(c) if c in keys else F.col(f"_c.{c}") for c in row.names], "_c.ts_ms", "_c.offset", "_c.op", "seen"))


def start_state(messages: DataFrame, row: T.StructType, table: KeyedTable, checkpoint: str, unwrapped: bool = False,
                job: str = "changes", compact_every: int | None = 8, **trigger) -> StreamingQuery:
    """Changes kept as a keyed state: each batch writes the latest change of each key it names, deletes as rows of operation `d`.

    Messages may come late or more than once: the table keeps the latest change of all that were seen.
    """
    v = table.version()
    if "seen" not in v.greatest:
        raise ValueError(f"{table.path} was not made by state_table")
    return out.keyed_stream(messages, table, job, checkpoint, "append", compact_every,
                            reduce=lambda batch: row_deltas(batch, row, v.keys, unwrapped), **trigger)


def state_rows(table: KeyedTable, row: T.StructType) -> DataFrame:
    """The rows that are there; what is read follows the keys, not the messages."""
    return table.scan().where(F.coalesce(F.col("op") != "d", F.lit(True))).select(*row.names)


def position(table: KeyedTable) -> DataFrame:
    """`seen`: the last place of the log among all messages that changed a key."""
    return table.scan().agg(F.max("seen").alias("seen"))
