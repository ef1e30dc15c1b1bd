"""Data quality: expectation suites evaluated in a fixed number of passes.

All column and table expectations of a suite are conditional aggregates of one pass.
Uniqueness needs the values grouped: all unique columns share one more pass.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featloom.functions.time import Instant, instant
from featloom.functions.values import ratio

# Expectation types, by what they look at.
ROW_CHECKS = (
    "expect_column_values_to_not_be_null",
    "expect_column_values_to_be_in_set",
    "expect_column_values_to_be_between",
    "expect_column_values_to_match_regex",
)
UNIQUE_CHECK = "expect_column_values_to_be_unique"
EXISTS_CHECK = "expect_column_to_exist"
ROW_COUNT_CHECK = "expect_table_row_count_to_be_between"
STATISTIC_CHECKS = {
    "expect_column_mean_to_be_between": F.avg,
    "expect_column_min_to_be_between": F.min,
    "expect_column_max_to_be_between": F.max,
}
TYPES = (*ROW_CHECKS, UNIQUE_CHECK, EXISTS_CHECK, ROW_COUNT_CHECK, *STATISTIC_CHECKS)

RESULT = ("position", "expectation_type", "column_name", "success", "element_count",
          "unexpected_count", "unexpected_percent", "observed_value", "error")


@dataclass(frozen=True)
class Expectation:
    expectation_type: str
    kwargs: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    @property
    def column(self) -> str | None:
        return self.kwargs.get("column")


@dataclass(frozen=True)
class Suite:
    name: str
    expectations: tuple[Expectation, ...]


def make_suite(name: str, expectations: Sequence[dict]) -> Suite:
    """A suite from `{expectation_type, kwargs, meta}` entries."""
    return Suite(name, tuple(
        Expectation(e["expectation_type"], dict(e.get("kwargs", {})), dict(e.get("meta", {})))
        for e in expectations))


def _within(value: Column, kwargs: dict) -> Column:
    ok = F.lit(True)
    low, high = kwargs.get("min_value"), kwargs.get("max_value")
    if low is not None:
        ok = ok & (value > F.lit(low) if kwargs.get("strict_min") else value >= F.lit(low))
    if high is not None:
        ok = ok & (value < F.lit(high) if kwargs.get("strict_max") else value <= F.lit(high))
    return ok


def _fails(e: Expectation, kind: T.DataType) -> Column:
    """True on rows that break the expectation; NULL values break only the not-null one."""
    c = F.col(e.column)
    if e.expectation_type == "expect_column_values_to_not_be_null":
        return c.isNull()
    if e.expectation_type == "expect_column_values_to_be_in_set":
        # members of another type are in no row
        members = [F.lit(m).cast(kind) for m in e.kwargs["value_set"] if _fits(m, kind)]
        return c.isNotNull() & ~(c.isin(members) if members else F.lit(False))
    if e.expectation_type == "expect_column_values_to_be_between":
        return c.isNotNull() & ~_within(c, e.kwargs)
    text = c.cast("string") if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(c)
    return c.isNotNull() & ~text.rlike(e.kwargs["regex"])


def _fits(value: object, kind: T.DataType) -> bool:
    """Whether a bound or set member can be compared with a column of this type as it is."""
    if isinstance(value, bool) or isinstance(kind, T.BooleanType):
        return isinstance(value, bool) and isinstance(kind, T.BooleanType)
    if isinstance(kind, T.NumericType):
        return isinstance(value, (int, float, decimal.Decimal))
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str):
            try:
                dt.datetime.fromisoformat(value)
            except ValueError:
                return False
            return True
        return isinstance(value, dt.date)
    return False


def _bad_bounds(e: Expectation, kind: T.DataType) -> str | None:
    bounds = {k: e.kwargs[k] for k in ("min_value", "max_value") if e.kwargs.get(k) is not None}
    if not bounds:
        return "no min_value and no max_value given"
    for name, bound in bounds.items():
        if not _fits(bound, kind):
            return f"{name} {bound!r} cannot be compared with {kind.simpleString()}"
    return None


def _bad_regex(df: DataFrame, pattern: object) -> str | None:
    if not isinstance(pattern, str):
        return "no regex given"
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # whatever the engine says of it, it cannot be used
        return f"regex {pattern!r} cannot be read"
    return None


def _error(e: Expectation, df: DataFrame) -> str | None:
    """Why an expectation cannot be evaluated, found before anything runs."""
    if e.expectation_type not in TYPES:
        return f"unknown expectation type {e.expectation_type}"
    mostly = e.kwargs.get("mostly", 1.0)
    if isinstance(mostly, bool) or not isinstance(mostly, (int, float)) or not 0 <= mostly <= 1:
        return f"mostly {mostly!r} is no share"
    if e.expectation_type == ROW_COUNT_CHECK:
        return _bad_bounds(e, T.LongType())
    if e.column is None:
        return "no column given"
    if e.expectation_type == EXISTS_CHECK:
        return None
    if e.column not in df.columns:
        return f"column {e.column} not found"
    kind = df.schema[e.column].dataType
    if e.expectation_type == "expect_column_values_to_be_in_set":
        return None if isinstance(e.kwargs.get("value_set"), (list, tuple, set)) else "no value_set given"
    if e.expectation_type == "expect_column_values_to_match_regex":
        return _bad_regex(df, e.kwargs.get("regex"))
    if e.expectation_type == "expect_column_values_to_be_between":
        return _bad_bounds(e, kind)
    if e.expectation_type in STATISTIC_CHECKS:
        return _bad_bounds(e, kind) if isinstance(kind, T.NumericType) else f"{kind.simpleString()} has no such statistic"
    if e.expectation_type == UNIQUE_CHECK and isinstance(kind, (T.MapType, T.VariantType)):
        return f"values of {kind.simpleString()} cannot be grouped"
    return None


def _result(position: int, e: Expectation, success: Column, elements: Column, unexpected: Column,
            observed: Column, error: str | None = None) -> Column:
    return F.struct(
        F.lit(position).alias("position"), F.lit(e.expectation_type).alias("expectation_type"),
        F.lit(e.column).cast("string").alias("column_name"), success.cast("boolean").alias("success"),
        elements.cast("bigint").alias("element_count"), unexpected.cast("bigint").alias("unexpected_count"),
        (ratio(unexpected, elements) * 100).alias("unexpected_percent"),
        observed.cast("double").alias("observed_value"), F.lit(error).cast("string").alias("error"))


def _enough(unexpected: Column, elements: Column, e: Expectation) -> Column:
    share = F.lit(1.0) - F.coalesce(ratio(unexpected, elements), F.lit(0.0))
    return share >= F.lit(float(e.kwargs.get("mostly", 1.0)))


def validate(df: DataFrame, suite: Suite) -> DataFrame:
    """One row per expectation. A broken expectation is a failed row with its error text."""
    nothing = F.lit(None)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    unique: list[tuple[int, Expectation]] = []
    results: list[Column] = []
    for i, e in enumerate(suite.expectations):
        error = _error(e, df)
        if error:
            results.append(_result(i, e, F.lit(False), nothing, nothing, nothing, error))
        elif e.expectation_type == EXISTS_CHECK:
            results.append(_result(i, e, F.lit(e.column in df.columns), nothing, nothing, nothing))
        elif e.expectation_type == ROW_COUNT_CHECK:
            results.append(_result(i, e, _within(F.col("rows"), e.kwargs), nothing, nothing, F.col("rows")))
        elif e.expectation_type in STATISTIC_CHECKS:
            aggregates.append(STATISTIC_CHECKS[e.expectation_type](F.col(e.column)).cast("double").alias(f"s{i}"))
            seen = F.col(f"s{i}")
            results.append(_result(i, e, F.coalesce(_within(seen, e.kwargs), F.lit(False)),
                                   nothing, nothing, seen))
        elif e.expectation_type == UNIQUE_CHECK:
            unique.append((i, e))
        else:
            aggregates.append(F.count_if(_fails(e, df.schema[e.column].dataType)).alias(f"u{i}"))
            elements = F.col("rows")
            if e.expectation_type != "expect_column_values_to_not_be_null":
                aggregates.append(F.count(e.column).alias(f"n{i}"))
                elements = F.col(f"n{i}")
            results.append(_result(i, e, _enough(F.col(f"u{i}"), elements, e), elements, F.col(f"u{i}"), nothing))
    out = None
    if results:
        out = df.agg(*aggregates).select(F.inline(F.array(*results)))
    if unique:
        repeated = _repeated_values(df, unique)
        out = repeated if out is None else out.unionByName(repeated)
    if out is None:
        raise ValueError(f"suite {suite.name} is empty")
    return out.withColumn("suite", F.lit(suite.name))


def _repeated_values(df: DataFrame, checks: list[tuple[int, Expectation]]) -> DataFrame:
    kinds = {df.schema[e.column].dataType for _, e in checks}
    plain = lambda c: F.col(c) if len(kinds) == 1 else F.to_json(F.struct(F.col(c).alias("x")))
    cells = F.array(*[F.struct(F.lit(i).alias("position"),
                               F.when(F.col(e.column).isNotNull(), plain(e.column)).alias("v")) for i, e in checks])
    per_value = (df.select(F.inline(cells)).filter(F.col("v").isNotNull())
                 .groupBy("position", "v").agg(F.count(F.lit(1)).alias("n")))
    n = F.col("n")
    totals = per_value.groupBy().agg(*[a for i, _ in checks for a in (
        F.coalesce(F.sum(F.when(F.col("position") == i, n)), F.lit(0)).alias(f"n{i}"),
        F.coalesce(F.sum(F.when((F.col("position") == i) & (n > 1), n)), F.lit(0)).alias(f"u{i}"))])
    rows = [_result(i, e, _enough(F.col(f"u{i}"), F.col(f"n{i}"), e), F.col(f"n{i}"), F.col(f"u{i}"),
                    F.lit(None)) for i, e in checks]
    return totals.select(F.inline(F.array(*rows)))


def summary(results: DataFrame) -> DataFrame:
    """Evaluated, successful and unsuccessful expectations per suite, and overall success."""
    good = F.count_if("success")
    return results.groupBy("suite").agg(
        F.count(F.lit(1)).alias("evaluated_expectations"), good.alias("successful_expectations"),
        F.count_if(~F.col("success")).alias("unsuccessful_expectations"),
        (good == F.count(F.lit(1))).alias("success"))


def validate_batch(batch_id: str, df: DataFrame, suite: Suite, as_of: Instant = None,
                   run_name: str | None = None) -> DataFrame:
    """Results of one batch, ready to append to a result table; fits `foreachBatch`."""
    now = instant(as_of, "timestamp_ntz")
    stamp = F.date_format(now, "yyyyMMdd_HHmmss")
    name = F.lit(run_name) if run_name else F.concat(F.lit(f"spark_batch_{batch_id}_"), stamp)
    return (validate(df, suite).withColumn("batch_id", F.lit(str(batch_id)))
            .withColumn("run_name", name).withColumn("run_at", now))


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)
