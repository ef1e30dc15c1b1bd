"""Surrogate keys and key lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BUCKETS = 4096  # three hex digits of the digest


def dense_keys(df: DataFrame, natural_key: str, out: str, start: int = 0) -> DataFrame:
    """Gap-free surrogate keys `start + 1 ...`, the same on every run.

    Members are numbered inside hash buckets of their natural key, and buckets are
    shifted by the sizes of the buckets before them, so no task numbers everything.
    """
    bucket = F.substring(F.md5(F.col(natural_key).cast("string")), 1, 3)
    placed = df.withColumn("_bucket", bucket)
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_bucket").orderBy(natural_key)
    # at most BUCKETS rows, whatever the table size
    return (placed.withColumn("_n", F.row_number().over(inside))
            .join(F.broadcast(shifts), "_bucket")
            .withColumn(out, F.col("_n") + F.col("_shift") + F.lit(start))
            .select(out, *df.columns))


def extend_dimension(existing: DataFrame, incoming: DataFrame, natural_key: str, key: str) -> DataFrame:
    """`existing` plus new members; members already known keep their key."""
    fresh = incoming.join(existing.select(natural_key), natural_key, "left_anti")
    top = existing.agg(F.max(key)).first()[0] or 0  # one number
    return existing.unionByName(dense_keys(fresh, natural_key, key, top).select(*existing.columns))


def lookup(facts: DataFrame, dimension: DataFrame, natural_key: str, key: str) -> DataFrame:
    """Facts with the dimension's surrogate key in place of its natural key."""
    return facts.join(dimension.select(natural_key, key), natural_key).drop(natural_key)


def unknown(facts: DataFrame, dimension: DataFrame, natural_key: str) -> DataFrame:
    """Facts that refer to no member of the dimension."""
    return facts.join(dimension.select(natural_key), natural_key, "left_anti")
