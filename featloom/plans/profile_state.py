"""Column profiles that add up: each batch leaves one row per column, and profiles merge those rows.

A row holds counts, extremes, mean and variance, a HyperLogLog sketch of the distinct values and a KLL sketch of
the ranks of numbers. Merged over batches, rows, values, min, max and missing share are exact, mean and standard
deviation equal those of the union up to rounding, the unique count has a standard error of 1.6 % (2^12 registers),
and the median a rank error below 1.7 % at 99 % confidence (k = 200). A stored row has a few kilobytes,
whatever the batch holds. Columns without values have NULL statistics and a unique count of 0; NaN is a missing value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from featloom.functions.values import ratio
from featloom.sinks.keyed import KeyedTable

REGISTERS, RANKS = 12, 200
KINDS = ("batch bigint, column_name string, n_rows bigint, n bigint, low double, high double, mean double, "
         "squares double, distinct_values binary, ranks binary")


def _parts(df: DataFrame, c: str, i: int) -> list[Column]:
    kind = df.schema[c].dataType
    number = isinstance(kind, T.NumericType)
    seen = F.nanvl(F.col(c), F.lit(None).cast(kind)) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(c)
    value = seen.cast("double") if number else F.lit(None).cast("double")
    text = seen if isinstance(kind, T.StringType) else F.to_json(F.struct(seen.alias("x")))
    n = F.count(seen)
    named = {"n": n, "low": F.min(value), "high": F.max(value), "mean": F.avg(value), "squares": F.var_pop(value) * n,
             "distinct_values": F.hll_sketch_agg(F.when(seen.isNotNull(), text), F.lit(REGISTERS)),
             "ranks": F.kll_sketch_agg_double(value, F.lit(RANKS)) if number else F.max(F.lit(None).cast("binary"))}
    return [agg.alias(f"{name}__{i}") for name, agg in named.items()]


def partial(df: DataFrame, columns: Sequence[str], batch: int) -> DataFrame:
    """The stored rows of one batch, one for each column, from one pass."""
    names = ("n", "low", "high", "mean", "squares", "distinct_values", "ranks")
    aggs = [a for i, c in enumerate(columns) for a in _parts(df, c, i)]
    rows = [F.struct(F.lit(batch).cast("bigint").alias("batch"), F.lit(c).alias("column_name"), "n_rows",
                     *[F.col(f"{m}__{i}").alias(m) for m in names]) for i, c in enumerate(columns)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs).select(F.inline(F.array(*rows)))


def merged(partials: DataFrame) -> DataFrame:
    """The profile of all batches together: one row per column."""
    weighed = F.when(F.col("n") > 0, F.col("mean") * F.col("n"))
    whole = partials.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("values"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.try_divide(F.sum(weighed), F.sum("n")).alias("mean"), F.hll_union_agg("distinct_values").alias("_distinct"),
        F.kll_merge_agg_double("ranks").alias("_ranks"))
    # squares about the common mean: those of each batch, and the way from its mean to the common one
    apart = partials.join(whole.select("column_name", F.col("mean").alias("_mean")), "column_name").groupBy("column_name").agg(
        F.sum(F.when(F.col("n") > 0, F.col("squares") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)).alias("_squares"))
    return whole.join(apart, "column_name").select(
        "column_name", "n_rows", "values", "min", "max", "mean",
        F.when(F.col("values") > 1, F.sqrt(F.col("_squares") / (F.col("values") - 1))).alias("stddev"),
        F.when(F.col("max").isNotNull(), F.kll_sketch_get_quantile_double("_ranks", F.lit(0.5))).alias("median"),
        F.coalesce(F.hll_sketch_estimate("_distinct"), F.lit(0)).alias("unique_count"),
        (ratio(F.col("n_rows") - F.col("values"), F.col("n_rows")) * 100).alias("missing_percentage"))


class ProfileState:
    """Stored profiles of batches; a batch that is taken in again under its number changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> ProfileState:
        KeyedTable.create(spark, path, spark.createDataFrame([], KINDS).schema, ["batch", "column_name"], buckets=1)
        return cls(spark, path)

    def add(self, df: DataFrame, columns: Sequence[str], batch: int) -> None:
        """Batches come in the order of their numbers."""
        self.table.write(partial(df, columns, batch), job="profile", batch=batch)

    def profile(self) -> DataFrame:
        return merged(self.table.scan())
