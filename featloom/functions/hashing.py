"""Deterministic hash buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_bucket(key: Column, buckets: int, salt: str | int = "", method: str = "md5") -> Column:
    """A stable bucket in [0, buckets).

    `md5` gives the same bucket in any engine; `xxhash64` is cheaper inside Spark.
    """
    if method == "xxhash64":
        return F.pmod(F.xxhash64(key.cast("string"), F.lit(str(salt))), F.lit(buckets)).cast("int")
    digest = F.md5(F.concat(F.lit(str(salt)), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def in_sample(key: Column, percent: float, seed: int = 22, method: str = "md5") -> Column:
    """True for about `percent` of the keys; a key is always in or always out."""
    return hash_bucket(key, 10_000, seed, method) < int(round(percent * 100))
