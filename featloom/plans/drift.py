"""Drift between a baseline and current data: PSI, KS and verdicts.

`sides` frames hold the features and a boolean `is_current`. Rows are reduced to
distinct values with a count per side before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from featloom.functions.time import Instant, instant_like, interval
from featloom.functions.values import ratio
from featloom.operators import ranks

SHARE_FLOOR = 1e-4
BINS = 10


@dataclass(frozen=True)
class DriftConfig:
    model: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    ks_threshold: float | None = 0.2
    psi_threshold: float | None = 0.2


# Monitored models and the monitoring window.
CREDIT_RISK = DriftConfig("credit_risk_model", ("age", "income", "credit_score", "employment_years"))
CUSTOMER_CHURN = DriftConfig("customer_churn_model", ("monthly_charges", "total_charges", "tenure"),
                             ("contract_type",), 0.15, 0.15)
WINDOW_HOURS = 24
CHECK_MINUTES = 60
MIN_SAMPLES = 1000
METRIC_PREFIX = "model_drift"


def _side_counts() -> dict[str, Column]:
    now = F.col("is_current").cast("int")
    return {"expected": F.lit(1) - now, "actual": now}


def both_sides(baseline: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    return (baseline.select(*features, F.lit(False).alias("is_current"))
            .unionByName(current.select(*features, F.lit(True).alias("is_current"))))


def numeric_counts(sides: DataFrame, features: Sequence[str]) -> DataFrame:
    long = ranks.tall(sides, features, keep=["is_current"])
    return ranks.value_counts(long, ["feature"], "v", _side_counts())


def bucket_of(value: Column, edges: Column) -> Column:
    """How many edges lie below the value."""
    return F.size(F.filter(edges, lambda e: value > e))


def _psi_term(expected: Column, actual: Column) -> Column:
    floor = F.lit(SHARE_FLOOR)
    e, a = F.greatest(expected, floor), F.greatest(actual, floor)
    return (a - e) * F.log(a / e)


def psi_from_buckets(buckets: DataFrame, keys: Sequence[str], bucket: str,
                     carry: dict[str, Column] | None = None) -> DataFrame:
    """PSI and sample sizes per `keys` from `expected` and `actual` counts per bucket."""
    carry = carry or {}
    counted = (buckets.groupBy(*keys, bucket)
               .agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"),
                    *[c.alias(n) for n, c in carry.items()]))
    entire = counted.groupBy(*keys).agg(F.sum("expected").alias("_e"), F.sum("actual").alias("_a"))
    term = _psi_term(ratio(F.col("expected"), F.col("_e")), ratio(F.col("actual"), F.col("_a")))
    shares = counted.join(entire, list(keys)).select(*keys, "expected", "actual", *carry, term.alias("_t"))
    return shares.groupBy(*keys).agg(F.sum("_t").alias("psi"), F.sum("expected").alias("n_baseline"),
                                     F.sum("actual").alias("n_current"),
                                     *[F.max(n).alias(n) for n in carry])


def numeric_drift(sides: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """PSI over baseline quantiles and KS per numeric feature.

    Both are read off one frame of value counts: running totals give the KS distance
    and the exact inner quantiles of the baseline, which then bucket the same counts.
    """
    counts = numeric_counts(sides, features)
    totals = ranks.running_totals(counts, ["feature"], "v", ["expected", "actual"])
    gap = F.abs(ratio(F.col("cum_expected"), F.col("all_expected"))
                - ratio(F.col("cum_actual"), F.col("all_actual")))
    edges = ranks.discrete_quantiles("v", "expected", [i / bins for i in range(1, bins)])
    per_feature = totals.groupBy("feature").agg(F.max(gap).alias("ks"), edges.alias("edges"))
    # one short row per configured feature
    placed = counts.join(F.broadcast(per_feature), "feature").withColumn(
        "bucket", bucket_of(F.col("v"), F.col("edges")))
    return psi_from_buckets(placed, ["feature"], "bucket", {"ks": F.max("ks")})


def categorical_drift(sides: DataFrame, features: Sequence[str]) -> DataFrame:
    """PSI per categorical feature, one bucket per value."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bucket"))
                      for c in features])
    long = sides.select("is_current", F.inline(cells)).filter(F.col("bucket").isNotNull())
    counts = long.groupBy("feature", "bucket").agg(*[F.sum(m).alias(n) for n, m in _side_counts().items()])
    return psi_from_buckets(counts, ["feature"], "bucket").withColumn("ks", F.lit(None).cast("double"))


def feature_drift(sides: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                  bins: int = BINS) -> DataFrame:
    """(feature, psi, ks, n_baseline, n_current); KS is NULL for categorical features."""
    columns = ["feature", "psi", "ks", "n_baseline", "n_current"]
    parts = []
    if numeric:
        parts.append(numeric_drift(sides, numeric, bins).select(*columns))
    if categorical:
        parts.append(categorical_drift(sides, categorical).select(*columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def psi(sides: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
        bins: int = BINS) -> DataFrame:
    return feature_drift(sides, numeric, categorical, bins).select(
        "feature", F.col("psi").alias("score"), "n_baseline", "n_current")


def ks(sides: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """The greatest distance of the two cumulative shares per feature."""
    totals = ranks.running_totals(numeric_counts(sides, numeric), ["feature"], "v", ["expected", "actual"])
    gap = F.abs(ratio(F.col("cum_expected"), F.col("all_expected"))
                - ratio(F.col("cum_actual"), F.col("all_actual")))
    return totals.groupBy("feature").agg(
        F.max(gap).alias("score"), F.max("all_expected").alias("n_baseline"),
        F.max("all_actual").alias("n_current"))


def report(sides: DataFrame, config: DriftConfig, min_samples: int = MIN_SAMPLES,
           bins: int = BINS) -> DataFrame:
    """One row per metric and feature with its verdict; too few samples give no verdict."""
    metrics = {"psi": config.psi_threshold, "ks_test": config.ks_threshold}
    rows = F.array(*[
        F.struct(F.lit(f"{METRIC_PREFIX}_{name}").alias("metric"),
                 F.col("psi" if name == "psi" else "ks").alias("score"),
                 F.lit(float(threshold)).alias("threshold"))
        for name, threshold in metrics.items() if threshold is not None])
    drifted = feature_drift(sides, config.numeric, config.categorical, bins)
    return (drifted.select("feature", "n_baseline", "n_current", F.inline(rows))
            .filter(F.col("score").isNotNull())
            .select(F.lit(config.model).alias("model_name"), "metric", "feature", "score", "threshold",
                    "n_baseline", "n_current",
                    F.when(F.col("n_current") >= min_samples, F.col("score") > F.col("threshold"))
                    .alias("is_drifted")))


def current_window(log: DataFrame, moment: str, as_of: Instant = None, hours: int = WINDOW_HOURS) -> DataFrame:
    now = instant_like(log, moment, as_of)
    return log.filter((F.col(moment) > now - interval(hours, "hour")) & (F.col(moment) <= now))


@dataclass(frozen=True)
class Baseline:
    """What a numeric feature's baseline looked like: inner edges and rows per bucket."""
    feature: str
    edges: tuple[float, ...]
    counts: tuple[int, ...]


def fit_baseline(baseline: DataFrame, feature: str, bins: int = BINS) -> Baseline:
    """Reduce a baseline to `bins` counts, once; later checks need no baseline rows.

    NULL and NaN do not count. A baseline without values has no edges and one empty bucket
    that all data falls into, as in `psi`. Only the edges and counts come to the driver.
    """
    counts = ranks.value_counts(ranks.tall(baseline, [feature]), ["feature"], "v", {"n": F.lit(1)})
    totals = ranks.running_totals(counts, ["feature"], "v", ["n"])
    row = totals.agg(ranks.discrete_quantiles("v", "n", [i / bins for i in range(1, bins)]).alias("edges")).first()
    edges = tuple(e for e in row["edges"] if e is not None)
    inside = _literal_bucket(F.col(feature).cast("double"), edges)
    found = _with_number(baseline, feature).agg(
        *[F.count_if(inside == i).alias(f"b{i}") for i in range(bins)]).first()
    return Baseline(feature, edges, tuple(found))


def _with_number(df: DataFrame, feature: str) -> DataFrame:
    value = F.col(feature).cast("double")
    return df.filter(value.isNotNull() & ~F.isnan(value))


def _literal_bucket(value: Column, edges: Sequence[float]) -> Column:
    if not edges:
        return F.lit(0)
    out = None
    for i, e in enumerate(edges):
        out = F.when(value <= e, i) if out is None else out.when(value <= e, i)
    return out.otherwise(len(edges))


def hourly_psi(baseline: Baseline, log: DataFrame, moment: str, hours: int = WINDOW_HOURS,
               check_minutes: int = CHECK_MINUTES, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """PSI of a feature in sliding windows with enough samples; works on streams too.

    On static frames the log is counted per check interval first and windows add up
    those counts, so rows are not copied once per window they belong to.
    """
    names = [f"b{i}" for i in range(len(baseline.counts))]
    bucket = _literal_bucket(F.col(baseline.feature).cast("double"), baseline.edges)
    step, width = f"{check_minutes} minutes", f"{hours} hours"
    seen = _with_number(log, baseline.feature)
    hits = {n: F.count_if(bucket == i) for i, n in enumerate(names)}
    if log.isStreaming:
        wide = seen.groupBy(F.window(moment, width, step).alias("window")).agg(
            *[h.alias(n) for n, h in hits.items()])
    else:
        panes = (seen.groupBy(F.window(moment, step).alias("_w")).agg(*[h.alias(n) for n, h in hits.items()])
                 .withColumn("pane", F.col("_w.start")))
        wide = panes.groupBy(F.window("pane", width, step).alias("window")).agg(
            *[F.sum(n).alias(n) for n in names])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    known = sum(baseline.counts)
    score = None
    for n, count in zip(names, baseline.counts):
        term = _psi_term(F.lit(count / known if known else 0.0), ratio(F.col(n), total))
        score = term if score is None else score + term
    return (wide.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                        score.alias("score"), total.alias("n_current"))
            .filter(F.col("n_current") >= min_samples))
