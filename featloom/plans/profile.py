"""Column statistics kept with a feature definition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featloom.functions.values import ratio
from featloom.operators import ranks

BASIC = {"_n": F.count, "min": F.min, "max": F.max, "mean": F.avg, "stddev": F.stddev_samp}


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _exact_kind(kind: T.DataType) -> str:
    """The type a column's values are compared in: no two values of it fall together."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    return kind.simpleString() if isinstance(kind, T.DecimalType) else "bigint"


def _seen(df: DataFrame, c: str) -> Column:
    """The values that count: neither NULL nor NaN."""
    kind = df.schema[c].dataType
    return F.nanvl(F.col(c), F.lit(None).cast(kind)) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(c)


def _per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One row per column from one pass; `measures` maps names to aggregates, all but `_n` of numbers only."""
    def value(c: str, m: str, f) -> Column:
        if m in ("_n", "unique_count"):
            return f(_seen(df, c))
        number = _is_number(df.schema[c].dataType)
        return f(_seen(df, c)).cast("double") if number else F.max(F.lit(None).cast("double"))
    aggs = [value(c, m, f).alias(f"{m}__{i}") for i, c in enumerate(columns) for m, f in measures.items()]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("_rows"), *[F.col(f"{m}__{i}").alias(m) for m in measures])
            for i, c in enumerate(columns)]
    return df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).select(F.inline(F.array(*rows)))


def _missing() -> Column:
    return (ratio(F.col("_rows") - F.col("_n"), F.col("_rows")) * 100).alias("missing_percentage")


def _ordered(df: DataFrame, columns: Sequence[str], kind: str, bins: int) -> DataFrame:
    """Median, unique count, rows and histogram of number columns of one kind, from their distinct values."""
    counts = ranks.value_counts(ranks.tall(df, columns, "column_name", kind=kind), ["column_name"], "v", {"n": F.lit(1)})
    v, n = F.col("v").cast("double"), F.col("n")
    ends = counts.groupBy("column_name").agg(F.min("v").cast("double").alias("_low"), F.max("v").cast("double").alias("_high"))
    totals = ranks.running_totals(counts, ["column_name"], "v", ["n"]).join(ends, "column_name")
    width = (F.col("_high") - F.col("_low")) / bins
    # a single value has width 0 and falls into the first step
    step = F.least(F.coalesce(F.floor(F.try_divide(v - F.col("_low"), width)), F.lit(0)), F.lit(bins - 1))
    return totals.groupBy("column_name").agg(
        ranks.interpolated_quantile("v", "n", 0.5, "median"), F.count(F.lit(1)).alias("unique_count"),
        F.array(*[F.coalesce(F.sum(F.when(step == b, n)), F.lit(0)) for b in range(bins)]).alias("histogram"))


def _distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unique counts of columns of other types, by their JSON text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("x")))).alias("v")) for c in columns])
    distinct = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).distinct()
    return distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count")).select(
        "column_name", F.lit(None).cast("double").alias("median"), "unique_count",
        F.lit(None).cast("array<bigint>").alias("histogram"))


def profile(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Exact min, max, mean, median, stddev, unique count, missing share and a histogram.

    Number columns are reduced to distinct values with counts, compared in their own type.
    The histogram has `bins` equal steps between min and max. Columns of other types have a
    unique count and a missing share; their other statistics are NULL.
    """
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        kinds.setdefault(_exact_kind(kind) if _is_number(kind) else "", []).append(c)
    parts = [_ordered(df, of, kind, bins) if kind else _distinct(df, of) for kind, of in kinds.items()]
    ordered = parts[0]
    for p in parts[1:]:
        ordered = ordered.unionByName(p)
    return _per_column(df, columns, BASIC).join(ordered, "column_name", "left").select(
        "column_name", "min", "max", "mean", "median", "stddev",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"), _missing(), "histogram")


def profile_approximate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same statistics, without histogram, from one pass with sketches."""
    sketches = {"median": lambda x: F.percentile_approx(x, 0.5), "unique_count": F.approx_count_distinct}
    return _per_column(df, columns, {**BASIC, **sketches}).select(
        "column_name", "min", "max", "mean", "median", "stddev", "unique_count", _missing())
