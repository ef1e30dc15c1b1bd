"""Alert rules over evaluated metric series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from featloom.functions.time import epoch_micros


@dataclass(frozen=True)
class AlertRule:
    name: str
    threshold: float
    hold_seconds: int
    severity: str = "warning"


# The shipped rules; each breaches above its threshold and must hold.
RULES = {r.name: r for r in (
    AlertRule("HighErrorRate", 0.05, 300, "critical"),
    AlertRule("SlowResponseTime", 2.0, 300),
    AlertRule("ModelDrift", 0.5, 1800),
    AlertRule("HighCPUUsage", 0.85, 600),
    AlertRule("HighMemoryUsage", 0.85, 600),
    AlertRule("KafkaConsumerLag", 1000.0, 900),
)}


def episodes(series: DataFrame, labels: Sequence[str], moment: str, value: str, rule: AlertRule,
             step_seconds: int) -> DataFrame:
    """Unbroken runs of breaching evaluations, and whether the rule fired in them.

    `series` has one row per label set and evaluation step. A step without a row or
    without a breach ends the run. The rule fires once a run has lasted its hold time.
    A label set has at most one row per step, which bounds what the window sees.
    """
    step = F.floor(epoch_micros(F.col(moment)) / F.lit(step_seconds * 1e6)).cast("bigint")
    breaches = series.filter(F.col(value) > F.lit(rule.threshold)).withColumn("_step", step)
    run = F.col("_step") - F.row_number().over(Window.partitionBy(*labels).orderBy("_step"))
    lasted = (epoch_micros(F.max(moment)) - epoch_micros(F.min(moment))) / F.lit(1e6)
    return (breaches.withColumn("_run", run).groupBy(*labels, "_run")
            .agg(F.min(moment).alias("started_at"), F.max(moment).alias("last_at"),
                 F.count(F.lit(1)).alias("evaluations"), F.max(value).alias("peak"),
                 lasted.alias("held_seconds"))
            .withColumn("fired", F.col("held_seconds") >= rule.hold_seconds)
            .withColumn("alert", F.lit(rule.name)).withColumn("severity", F.lit(rule.severity))
            .drop("_run"))


def firing(series: DataFrame, labels: Sequence[str], moment: str, value: str, rule: AlertRule,
           step_seconds: int) -> DataFrame:
    return episodes(series, labels, moment, value, rule, step_seconds).filter("fired")
