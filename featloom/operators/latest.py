"""Latest row per key, keyed upserts, top rows per key, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featloom.functions.time import Instant, instant_like, interval
from featloom.session import written


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` columns per key; later columns break ties."""
    return top_n_by_key(df, keys, [F.col(c).desc() for c in order], 1)


def top_n_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows per key.

    Spark limits each group to `n` rows in every task before the shuffle as well as
    after it (up to its `windowGroupLimitThreshold`, 1000 by default), so a key that
    holds much of the data sends only `n` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    place = "_place"
    while place in (c.lower() for c in df.columns):
        place += "_"
    return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n).drop(place)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str],
           order: Sequence[str] = (), updated_at: str | None = None,
           as_of: Instant = None) -> DataFrame:
    """`base`, which has one row per key, with `updates` laid over it: an update replaces the row with its key.

    Among updates of one key the greatest `order` wins. `updated_at` names a column
    that every written row gets set to the evaluation time. Only the updates are reduced, and written, since
    they are needed twice; `base` is looked up by key, so few updates do not move a large table.
    """
    if updated_at:
        updates = updates.withColumn(updated_at, instant_like(base, updated_at, as_of))
    rest = [c for c in base.columns if c not in (*keys, *order)]
    # whole rows decide what the order leaves open, so that the result does not depend on chance
    tie = [F.to_json(F.struct(*rest)).desc()] if rest else []
    newest = written(top_n_by_key(updates.select(*base.columns), keys, [*(F.col(c).desc() for c in order), *tie], 1), "updates")
    return _without_keys(base, newest, keys).unionByName(newest)


def merge_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Like `upsert`, but an update replaces a row only if its `order` is greater.

    Rows of `base` without an update stay where they are.
    """
    newest = written(latest_by_key(updates.select(*base.columns), keys, order), "updates")
    touched = newest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    met = base.join(touched, same, "left_semi")
    return _without_keys(base, newest, keys).unionByName(latest_by_key(met.unionByName(newest), keys, order))


def _without_keys(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    other = gone.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return base.join(other, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_anti")


def retain(df: DataFrame, moment: str, days: int, as_of: Instant = None) -> DataFrame:
    """Rows not older than `days`; on a date-partitioned table whole partitions are pruned."""
    return df.filter(F.col(moment) >= instant_like(df, moment, as_of) - interval(days, "day"))


def changed_since(df: DataFrame, moment: str, hours: float, as_of: Instant = None,
                  strict: bool = False) -> DataFrame:
    since = instant_like(df, moment, as_of) - interval(hours, "hour")
    c = F.col(moment)
    return df.filter(c > since if strict else c >= since)


def in_time_range(df: DataFrame, moment: str, start: Instant = None, end: Instant = None) -> DataFrame:
    """Both ends inclusive, each applied only if given."""
    if start is not None:
        df = df.filter(F.col(moment) >= instant_like(df, moment, start))
    if end is not None:
        df = df.filter(F.col(moment) <= instant_like(df, moment, end))
    return df


def page(df: DataFrame, unique_key: Sequence[str], size: int, number: int) -> DataFrame:
    """One page of a listing in key order. For whole-table work use the frame itself."""
    return df.orderBy(*unique_key).offset(size * number).limit(size)
