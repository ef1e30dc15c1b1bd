"""Neighbours in time within a key: validity intervals and as-of joins.

A plain window over the key would put a whole key on one task. Here

* rows of one key and time are reduced first, in every task before the shuffle: only distinct
  (key, time) pairs enter the windows over time, and the full rows meet the result in a join, which Spark splits
  when one key or time is hot;
* each key is cut into time slices. Neighbours inside a slice come from a window over
  (key, slice), what crosses a border from a window that sees one row per slice. A
  task therefore sees at most the distinct times of a slice, or the slices of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featloom.functions.time import epoch_micros
from featloom.operators.latest import latest_by_key
from featloom.operators.nesting import repeated

SLICE_SECONDS = 600


def time_slice(moment: Column, seconds: int) -> Column:
    return F.floor(epoch_micros(moment) / F.lit(seconds * 1e6)).cast("bigint")


def _next_distinct(times: DataFrame, keys: Sequence[str], moment: str, out: str,
                   slice_seconds: int) -> DataFrame:
    """`times` (unique per key and moment) with the next moment of the key."""
    inside = Window.partitionBy(*keys, "_slice").orderBy(moment)
    marked = times.withColumn("_slice", time_slice(F.col(moment), slice_seconds)).select(
        "*", F.lead(moment).over(inside).alias(out), F.first(moment).over(inside).alias("_first"))
    is_last = F.col(out).isNull()
    across = Window.partitionBy(*keys).orderBy("_slice")
    borders = marked.filter(is_last).withColumn(out, F.lead("_first").over(across))
    return marked.filter(~is_last).unionByName(borders).drop("_slice", "_first")


def with_next(df: DataFrame, keys: Sequence[str], moment: str, out: str = "valid_to",
              tiebreak: Sequence[str] = (), slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """`df` with the start of the following row of the same key, NULL for the last row.

    Among rows of one key and moment one lasts until the next moment: that of the greatest
    `tiebreak`, then of the greatest other columns, and one copy of equal rows. The others
    end where they start, so the intervals of a key never overlap. Rows without a key or
    moment have no next. Columns must be of types that can be ordered.
    """
    rest = [c for c in df.columns if c not in (*keys, moment, *tiebreak)]
    order = F.struct(*tiebreak, *rest) if tiebreak or rest else F.lit(0)
    times = df.groupBy(*keys, moment).agg(F.max(order).alias("_winner"), F.count(F.lit(1)).alias("_rows"))
    following = _next_distinct(times, keys, moment, out, slice_seconds)
    known = F.col("_winner").isNotNull()
    wins = known & order.eqNullSafe(F.col("_winner"))
    several = F.coalesce(F.col("_rows") > 1, F.lit(False))
    alone = (df.join(following, [*keys, moment], "left").filter(~(wins & several))
             .withColumn(out, F.when(wins, F.col(out)).when(known, F.col(moment))).select(*df.columns, out))
    # where a moment has several rows its winner may have copies: one of them lasts
    best = (df.join(following.filter("_rows > 1"), [*keys, moment]).filter(wins)
            .groupBy(*df.columns).agg(F.first(out).alias(out), (F.count(F.lit(1)) - 1).alias("_others")))
    others = repeated(best.withColumn(out, F.col(moment)), "_others")
    return alone.unionByName(best.select(*df.columns, out)).unionByName(others.select(*df.columns, out))


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str,
               right_time: str, values: Sequence[str], strict: bool = False,
               tiebreak: Sequence[str] = (), slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Each left row with the values of the latest right row at or before its time.

    With `strict` the right row must be earlier. Left rows without a match are kept
    with NULLs. Among right rows of one time the greatest `tiebreak` wins, then the
    greatest values.
    """
    hit = F.struct(*[F.col(v) for v in values]).alias("_hit")
    order = [*tiebreak, *[v for v in values if v not in (*tiebreak, right_time)]]
    needed = list(dict.fromkeys([*keys, right_time, *tiebreak, *values]))
    # at equal times history comes first, or last if it must be strictly earlier
    history = (latest_by_key(right.select(*needed), [*keys, right_time], order or [right_time])
               .select(*keys, F.col(right_time).alias("_time"), hit, F.lit(1 if strict else 0).alias("_rank")))
    asked = (left.select(*keys, F.col(left_time).alias("_time")).distinct()
             .withColumn("_hit", F.lit(None)).withColumn("_rank", F.lit(0 if strict else 1)))
    asked_rank = 0 if strict else 1
    events = (history.unionByName(asked)
              .withColumn("_slice", time_slice(F.col("_time"), slice_seconds)))

    inside = (Window.partitionBy(*keys, "_slice").orderBy("_time", "_rank")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = (events.withColumn("_found", F.last("_hit", ignorenulls=True).over(inside))
              .filter(F.col("_rank") == asked_rank).drop("_hit", "_rank"))

    # one row per (key, slice): what is known at its end, carried over the following slices
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    known_at = F.when(F.col("_hit").isNotNull(), F.col("_time"))
    carried = (events.groupBy(*keys, "_slice")
               .agg(F.max_by("_hit", known_at).alias("_end"))
               .withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier))
               .drop("_end"))
    answers = (walked.join(carried, [*keys, "_slice"], "left")
               .select(*keys, F.col("_time").alias(left_time), F.coalesce("_found", "_carry").alias("_answer")))
    return left.join(answers, [*keys, left_time], "left").select(
        *left.columns, *[F.col("_answer")[v].alias(v) for v in values])


def valid_at(facts: DataFrame, asked: DataFrame, keys: Sequence[str], moment: str,
             valid_from: str = "valid_from", valid_to: str = "valid_to",
             slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Interval lookup `valid_from <= t < valid_to`, an open end meaning still valid.

    The intervals of a key must not overlap, so the latest one that has begun is the
    only candidate: an as-of join, not a pairing of all questions with all intervals.
    """
    values = [c for c in facts.columns if c not in keys]
    marked = facts.withColumn("_open", F.col(valid_to).isNull())
    found = as_of_join(asked, marked, keys, moment, valid_from, values, False, ["_open", valid_to], slice_seconds)
    t = F.col(moment)
    return found.filter(F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (t < F.col(valid_to))))
