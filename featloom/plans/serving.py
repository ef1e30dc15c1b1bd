"""Serving metrics: rates, latencies, histograms, request logs, lag.

Sliding windows add up counts of steps (panes) instead of copying every row into
each window it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featloom.functions.time import elapsed_ms
from featloom.functions.values import as_double, ratio

# Metric names kept by the allow-list.
ALLOWED_METRICS = (
    "container.cpu.usage", "container.memory.usage", "http.server.duration",
    "process.runtime.go.gc.pause_ns", "system.cpu.time", "system.memory.usage",
    "model_prediction_drift_score", "kafka_consumergroup_lag",
    "http_requests_total", "http_request_duration_seconds",
)
# Default upper bounds of the latency histogram, in the unit of the column; the last is open.
LATENCY_BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def sliding(panes: DataFrame, pane: str, width: str, step: str, keys: Sequence[str],
            sums: Sequence[str]) -> DataFrame:
    """Sums of pane counts over sliding windows; `pane` is the start of a step."""
    return (panes.groupBy(F.window(pane, width, step).alias("window"), *keys)
            .agg(*[F.sum(s).alias(s) for s in sums])
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    *keys, *sums))


def _panes(df: DataFrame, moment: str, step: str, keys: Sequence[str],
           measures: dict[str, Column]) -> DataFrame:
    return (df.groupBy(F.window(moment, step).alias("_w"), *keys)
            .agg(*[m.alias(n) for n, m in measures.items()])
            .select(F.col("_w.start").alias("pane"), *keys, *measures))


def rates(requests: DataFrame, moment: str, keys: Sequence[str], is_error: Column,
          width_seconds: int = 300, step_seconds: int = 30) -> DataFrame:
    """Requests per second and error share per trailing window, evaluated at every step."""
    width, step = f"{width_seconds} seconds", f"{step_seconds} seconds"
    panes = _panes(requests, moment, step, keys,
                   {"requests": F.count(F.lit(1)), "errors": F.count_if(is_error)})
    return (sliding(panes, "pane", width, step, keys, ["requests", "errors"])
            .withColumn("rate", as_double(F.col("requests")) / F.lit(float(width_seconds)))
            .withColumn("error_ratio", ratio(F.col("errors"), F.col("requests"))))


def bound_index(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound the value does not exceed; `len(bounds)` above all of them."""
    out = None
    for i, b in enumerate(bounds):
        out = F.when(value <= b, i) if out is None else out.when(value <= b, i)
    return out.otherwise(len(bounds))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Counts per bucket: `le` is the bucket's upper bound, NULL for the open one."""
    i = bound_index(F.col(value), bounds)
    le = F.element_at(F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double")), F.col("_i") + 1)
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, i.alias("_i"))
            .agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("_i").alias("bucket"), le.alias("le"), "n"))


def histogram_quantile(q: float, counts: Sequence[Column], bounds: Sequence[float]) -> Column:
    """Quantile of bucket counts, interpolated inside the bucket that reaches the rank.

    The lowest bucket starts at 0; a rank in the open bucket gives the last bound.
    """
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    rank = F.lit(q) * total
    out = None
    below: Column = F.lit(0)
    low = 0.0
    for c, high in zip(counts, bounds):
        value = F.lit(low) + F.lit(high - low) * ratio(rank - below, c)
        hit = (below + c >= rank) & (c > 0)
        out = F.when(hit, value) if out is None else out.when(hit, value)
        below, low = below + c, high
    return F.when(total > 0, out.otherwise(F.lit(float(bounds[-1]))))


def latency_quantile(requests: DataFrame, moment: str, keys: Sequence[str], latency: str, q: float = 0.95,
                     bounds: Sequence[float] = LATENCY_BOUNDS, width_seconds: int = 300,
                     step_seconds: int = 300) -> DataFrame:
    """Latency quantile per window from bucket counts."""
    width, step = f"{width_seconds} seconds", f"{step_seconds} seconds"
    i = bound_index(F.col(latency), bounds)
    names = [f"b{k}" for k in range(len(bounds) + 1)]
    panes = _panes(requests.filter(F.col(latency).isNotNull()), moment, step, keys,
                   {n: F.count_if(i == k) for k, n in enumerate(names)})
    wide = sliding(panes, "pane", width, step, keys, names)
    return wide.select("window_start", "window_end", *keys,
                       histogram_quantile(q, [F.col(n) for n in names], bounds).alias("latency"))


def latency_quantile_sketch(requests: DataFrame, moment: str, keys: Sequence[str], latency: str,
                            q: float = 0.95, width: str = "5 minutes") -> DataFrame:
    """Latency quantile per window straight from the values, by a mergeable sketch."""
    return (requests.groupBy(F.window(moment, width).alias("_w"), *keys)
            .agg(F.percentile_approx(latency, q).alias("latency"))
            .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "latency"))


def prediction_metrics(log: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Counters, latency histogram and the last drift score per model and version."""
    i = bound_index(F.col("latency_ms"), bounds)
    buckets = F.array(*[F.count_if(F.col("latency_ms").isNotNull() & (i == k)) for k in range(len(bounds) + 1)])
    drift_at = F.when(F.col("drift_score").isNotNull(), F.col("ts"))
    return log.groupBy("model_name", "model_version").agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("latency_ms").alias("latency_sum"), buckets.alias("latency_buckets"),
        F.max_by("drift_score", drift_at).alias("drift_score"))


def prediction_values(log: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Histogram of predicted values per model; list predictions count each element."""
    kind = log.schema["prediction"].dataType.typeName()
    values = log.withColumn("prediction", F.explode("prediction")) if kind == "array" else log
    return histogram(values, ["model_name", "model_version"], "prediction", bounds)


def client_summary(requests: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Requests, successes, success rate and mean latency of the successes."""
    ok = F.col("error").isNull()
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("successes"),
        (ratio(F.count_if(ok), F.count(F.lit(1))) * 100).alias("success_rate"),
        ratio(F.sum(F.when(ok, F.col("latency_ms"))), F.count(F.when(ok, F.col("latency_ms"))))
        .alias("avg_latency_ms"))


def request_log(requests: DataFrame) -> DataFrame:
    """Input size, result type and size, latency per request (`features` struct, `prediction` any)."""
    kind = requests.schema["prediction"].dataType.typeName()
    nested = kind in ("array", "struct", "map")
    result = F.to_json("prediction") if nested else F.col("prediction").cast("string")
    return requests.select(
        "request_id", F.length(F.to_json("features")).alias("input_size"),
        F.lit({"array": "list", "struct": "dict", "map": "dict"}.get(kind, kind)).alias("result_type"),
        F.length(result).alias("result_size"),
        elapsed_ms(F.col("started_at"), F.col("ended_at")).alias("latency_ms"),
        F.octet_length(F.to_json("features")).alias("input_bytes"))


def usage_ratio(usage: DataFrame, limits: DataFrame, keys: Sequence[str] = ("pod",)) -> DataFrame:
    """Summed usage over summed limit per key."""
    used = usage.groupBy(*keys).agg(F.sum("value").alias("usage"))
    limit = limits.groupBy(*keys).agg(F.sum("value").alias("limit"))
    return used.join(limit, list(keys)).withColumn("ratio", ratio(F.col("usage"), F.col("limit")))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Messages behind per consumer group and topic."""
    behind = F.greatest(F.col("latest") - F.coalesce("committed", F.lit(0)), F.lit(0))
    return offsets.groupBy("consumergroup", "topic").agg(F.sum(behind).alias("lag"))


def allowed_metrics(samples: DataFrame, names: Sequence[str] = ALLOWED_METRICS) -> DataFrame:
    return samples.filter(F.col("metric").isin(list(names)))


def with_attributes(samples: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """Resource attributes added where they are missing."""
    for name, value in attributes.items():
        old = F.col(f"`{name}`") if name in samples.columns else F.lit(None).cast("string")
        samples = samples.withColumn(name, F.coalesce(old, F.lit(value)))
    return samples
