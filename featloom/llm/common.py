"""Shared helpers: written stages, document shards and key buckets."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featloom.session import prepare, scratch_dir

#: Most bytes of a batch of rows in a Python task.
BATCH_BYTES = "4m"
#: What the contracts call white space: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read again, so a lost executor costs no recomputation."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for more columns of `df`: those given, longer where `df` has them already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose rows go to Python tasks in batches of a few megabytes however long its texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def give_back() -> None:
    """Return the unused memory of a Python worker to the machine; the worker goes on to other tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the C library of GNU systems has it
    if trim:
        trim(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a Python task, which gives unused memory back at its end."""
    yield from batches
    give_back()


def lean_table(table: pa.Table) -> pa.Table:
    """The same for the table of a group, of which a task may have many."""
    give_back()
    return table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_of(column: str | Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (an invertible mixer)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(32)
    return x


def heads(x: np.ndarray) -> np.ndarray:
    """Places where a value differs from the one before it."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.nonzero(new)[0]


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys change from one of `buckets` equal key ranges to the next."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges, side="left"), [len(keys)]))


# Hashes that are only counted travel as sorted 32-bit offsets in their bucket; two of a bucket that fall
# together count as one.

def offsets_in(keys: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    shift = max(0, ((1 << 64) // buckets).bit_length() - 32)
    return ((keys - np.uint64(bucket * (1 << 64) // buckets)) >> np.uint64(shift)).astype(np.uint32)


def pack(offsets: np.ndarray) -> bytes:
    return planes(np.diff(offsets, prepend=np.uint32(0)).astype("<u4"))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u4"), dtype=np.uint32)


# Numbers travel with their bytes sorted by weight: equal and empty bytes lie together and compress away.

def planes(numbers: np.ndarray) -> bytes:
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()
