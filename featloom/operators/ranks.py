"""Order statistics over whole columns without a single-task sort.

Rows are first reduced to distinct values with counts, so a value that holds much of
the data is one row. The distinct values are cut into chunks whose order follows the
value order and whose number follows the data; running sums inside a chunk come from a
window over the chunk, and what lies before it from sums over chunks of chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from featloom.functions.values import is_present

# Coarse steps for each doubling of the distance from the least value, and the distance
# (as a share of the whole range, in doublings) below which everything is one step.
STEPS_PER_OCTAVE = 64
OCTAVES = 64
# Distinct values a chunk should hold, and the most chunks of a coarse step.
CHUNK_VALUES = 1000
MOST_CHUNKS = 1 << 20


def tall(df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "v",
         keep: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """Columns as (name, value) rows of one type; NULL and NaN values are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns])
    out = df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")
    return out.filter(is_present(F.col(value), out.schema[value].dataType))


def value_counts(df: DataFrame, group: Sequence[str], value: str,
                 measures: dict[str, Column]) -> DataFrame:
    """One row per distinct value of a group, with summed measures."""
    return df.groupBy(*group, value).agg(*[F.sum(m).alias(n) for n, m in measures.items()])


def _distance(value: Column, low: Column, kind: T.DataType) -> Column:
    """`value - low` as a double that never falls as the value rises."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # halves, so that the widest ranges stay finite
        return value / 2 - low / 2
    apart = value.cast("double") - low.cast("double")
    return F.coalesce(F.try_subtract(value, low).cast("double"), apart)


def _coarse(distance: Column, span: Column) -> Column:
    """A number that never falls as the distance rises: steps are narrow next to the least value."""
    share = F.greatest(F.coalesce(F.try_divide(distance, span), F.lit(0.0)), F.lit(2.0 ** -OCTAVES))
    return F.coalesce(F.floor((F.log2(share) + OCTAVES) * STEPS_PER_OCTAVE).cast("int"), F.lit(0))


def chunked(counts: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """`counts` (one row per distinct value of a group) with `_coarse` and `_fine`, in value order together.

    A coarse step is cut into equal parts between its own least and greatest value, as
    many as its distinct values ask for. So chunks hold about `CHUNK_VALUES` values
    wherever the values lie.
    """
    kind = counts.schema[value].dataType
    ends = counts.groupBy(*group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    far = _distance(F.col(value), F.col("_low"), kind)
    placed = (_beside(counts, ends, group)
              .withColumn("_coarse", _coarse(far, _distance(F.col("_high"), F.col("_low"), kind))))
    steps = placed.groupBy(*group, "_coarse").agg(
        F.min(value).alias("_from"), F.max(value).alias("_to"), F.count(F.lit(1)).alias("_m"))
    parts = F.least(F.ceil(F.col("_m") / CHUNK_VALUES), F.lit(MOST_CHUNKS))
    share = F.try_divide(_distance(F.col(value), F.col("_from"), kind), _distance(F.col("_to"), F.col("_from"), kind))
    fine = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * parts), parts - 1).cast("int")
    return _beside(placed.drop("_low", "_high"), steps, [*group, "_coarse"]).withColumn("_fine", fine).drop("_from", "_to", "_m")


def _beside(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` with the facts of its keys; neither may be NULL."""
    return df.join(facts, list(keys))


def running_totals(counts: DataFrame, group: Sequence[str], value: str,
                   measures: Sequence[str]) -> DataFrame:
    """`counts` with `cum_<m>` (sum up to and with the value) and `all_<m>` per group."""
    cut = chunked(counts, group, value)
    sums = lambda of, to: [F.sum(of.format(m)).alias(to.format(m)) for m in measures]
    fine = cut.groupBy(*group, "_coarse", "_fine").agg(*sums("{}", "_f_{}"))
    coarse = fine.groupBy(*group, "_coarse").agg(*sums("_f_{}", "_c_{}"))
    entire = coarse.groupBy(*group).agg(*sums("_c_{}", "all_{}"))

    def before(df: DataFrame, keys: Sequence[str], by: str, of: str, to: str) -> DataFrame:
        earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*keys, by, *[F.coalesce(F.sum(of.format(m)).over(earlier), F.lit(0)).alias(to.format(m))
                                      for m in measures])

    # at most OCTAVES * STEPS_PER_OCTAVE coarse steps of a group, at most MOST_CHUNKS chunks of a step
    steps = _beside(before(coarse, group, "_coarse", "_c_{}", "_oc_{}"), entire, group)
    offsets = _beside(before(fine, [*group, "_coarse"], "_fine", "_f_{}", "_of_{}"), steps, [*group, "_coarse"])
    inside = (Window.partitionBy(*group, "_coarse", "_fine").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = cut.select("*", *[F.sum(m).over(inside).alias(f"_r_{m}") for m in measures])
    return (_beside(walked, offsets, [*group, "_coarse", "_fine"])
            .select(*counts.columns,
                    *[(F.col(f"_oc_{m}") + F.col(f"_of_{m}") + F.col(f"_r_{m}")).alias(f"cum_{m}") for m in measures],
                    *[f"all_{m}" for m in measures]))


def _at_rank(rank: Column, cum: str, count: str) -> Column:
    return (F.col(cum) >= rank) & (F.col(cum) - F.col(count) < rank)


def discrete_quantiles(value: str, measure: str, probabilities: Sequence[float]) -> Column:
    """An aggregate over `running_totals`: an ascending array of exact quantiles.

    Each is the smallest value that reaches its share of the group.
    """
    n = F.col(f"all_{measure}")
    picks = []
    for p in probabilities:
        rank = F.greatest(F.lit(1), n - F.floor(n - n * F.lit(p)))
        picks.append(F.max(F.when(_at_rank(rank, f"cum_{measure}", measure), F.col(value))))
    return F.array(*picks)


def interpolated_quantile(value: str, measure: str, probability: float, out: str) -> Column:
    """An aggregate over `running_totals` that gives the interpolated quantile of each group."""
    at = (F.col(f"all_{measure}") - 1) * F.lit(probability)
    low_rank, high_rank = F.floor(at) + 1, F.ceil(at) + 1
    seen = F.col(value).cast("double")
    low = F.max(F.when(_at_rank(low_rank, f"cum_{measure}", measure), seen))
    high = F.max(F.when(_at_rank(high_rank, f"cum_{measure}", measure), seen))
    share = F.max(at - F.floor(at))
    return (low + (high - low) * share).alias(out)
