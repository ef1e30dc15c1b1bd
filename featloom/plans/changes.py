"""Change-data messages: parsing, applying, classifying."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F, types as T

from featloom.operators.latest import latest_by_key
from featloom.schemas import change_body
from featloom.session import written

#: The order of changes of one key: their time, and the place in the log within one millisecond.
ORDER = ("ts_ms", "offset")


def _given(messages: DataFrame, column: str, kind: str):
    return F.col(column).cast(kind) if column in messages.columns else F.lit(None).cast(kind)


def _with_payload(fields: T.StructType) -> T.StructType:
    """The fields at the top level or inside `payload`, as a converter writes them with or without its schema."""
    return T.StructType([T.StructField("payload", fields), *(f for f in fields.fields if f.name != "payload")])


def _either(parsed: str, fields: T.StructType):
    top = F.struct(*[F.col(f"{parsed}.{f.name}").alias(f.name) for f in fields.fields if f.name != "payload"])
    return F.coalesce(F.col(f"{parsed}.payload"), top)


def read(messages: DataFrame, row: T.StructType, keys: Sequence[str], unwrapped: bool = False) -> DataFrame:
    """Every message as (key, value, table_name, op, ts_ms, offset, before, after, key_row, is_tombstone, is_readable).

    The topic ends in the table name. A value is the envelope of a change, or the bare row with
    `unwrapped`; either may stand inside `payload`, and so may the key. A message without a
    value is a tombstone: a delete of the row that its key names. A message is readable if it
    holds an operation and a row, a row with its key columns, or a tombstone's key. Messages
    without a time of their own have that of the record.
    """
    key_row = T.StructType([row[c] for c in keys])
    body = row if unwrapped else change_body(row)
    text, key = F.col("value").cast("string"), F.col("key").cast("string")
    parsed = F.struct(F.from_json(text, _with_payload(body)).alias("v"), F.from_json(key, _with_payload(key_row)).alias("k"))
    # a generator, so that the JSON text is parsed once however often its fields are read
    rows = messages.select(
        key.alias("key"), text.alias("value"), F.element_at(F.split("topic", r"\."), -1).alias("table_name"),
        _given(messages, "offset", "bigint").alias("offset"),
        F.unix_millis(_given(messages, "timestamp", "timestamp")).alias("_at"), F.inline(F.array(parsed)))
    rows = rows.select("key", "value", "table_name", "offset", "_at", _either("v", body).alias("_e"),
                       _either("k", key_row).alias("key_row"), F.col("value").isNull().alias("is_tombstone"))
    named = lambda c: reduce(and_, [F.col(f"{c}.{k}").isNotNull() for k in keys])
    if unwrapped:
        fields = [F.lit(None).cast("string").alias("op"), F.col("_at").alias("ts_ms"),
                  F.lit(None).cast(row).alias("before"), F.when(~F.col("is_tombstone"), F.col("_e")).alias("after")]
        good = named("_e")
    else:
        fields = [F.col("_e.op").alias("op"), F.coalesce("_e.ts_ms", "_at").alias("ts_ms"),
                  F.col("_e.before").alias("before"), F.col("_e.after").alias("after")]
        good = F.col("_e.op").isNotNull() & F.coalesce("_e.after", "_e.before").isNotNull()
    readable = F.coalesce(F.when(F.col("is_tombstone"), named("key_row")).otherwise(good), F.lit(False))
    return rows.select("key", "value", "table_name", *fields, "offset", "key_row", "is_tombstone", readable.alias("is_readable"))


def parse(messages: DataFrame, row: T.StructType, keys: Sequence[str], unwrapped: bool = False) -> DataFrame:
    """The readable messages; see `read`."""
    return read(messages, row, keys, unwrapped).filter("is_readable").drop("value", "is_readable")


def rejects(messages: DataFrame, row: T.StructType, keys: Sequence[str], unwrapped: bool = False) -> DataFrame:
    """The other messages as they came: (key, value, table_name, offset)."""
    return read(messages, row, keys, unwrapped).filter("NOT is_readable").select("key", "value", "table_name", "offset")


def flat(changes: DataFrame, row: T.StructType) -> DataFrame:
    """One row per change: the table's columns (after, before on a delete, the key alone for a tombstone), op, ts_ms, offset."""
    image = F.coalesce("after", "before")
    names = changes.schema["key_row"].dataType.names
    columns = [F.coalesce(image[f.name], F.col("key_row")[f.name]).alias(f.name) if f.name in names
               else image[f.name].alias(f.name) for f in row.fields]
    return changes.select(*columns, F.when(F.col("is_tombstone"), "d").otherwise(F.col("op")).alias("op"), "ts_ms", "offset")


def apply(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """The table after the changes: the latest change of a key wins, a delete removes it.

    `base` has one row per key and `changes` is the output of `flat`. Only the changes are
    reduced, and written, since they are needed twice; rows of `base` are looked up by key, so few
    changes do not move a large table.
    """
    newest = written(latest_by_key(changes, keys, order).select(*base.columns, "op"), "changes")
    kept = base.join(newest.select(*keys), list(keys), "left_anti").select(*base.columns)
    there = newest.filter(F.coalesce(F.col("op") != "d", F.lit(True)))
    return kept.unionByName(there.select(*base.columns))


def classify_orders(changes: DataFrame) -> DataFrame:
    """Order changes as `created`, `status_changed`, `updated`, `deleted` or `snapshot`."""
    moved = ~F.col("before.status").eqNullSafe(F.col("after.status"))
    kind = (F.when(F.col("op") == "c", "created").when(F.col("op") == "r", "snapshot")
            .when(F.col("op") == "d", "deleted").when(moved, "status_changed").otherwise("updated"))
    return changes.filter(~F.col("is_tombstone")).withColumn("change", kind)
