"""Serving metrics and alerts over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from featloom.catalog.base import SQL_LOG, Tables, query
from featloom.functions.hashing import in_sample
from featloom.plans import alerts as A, serving as V
from featloom.sources.streams import predictions

BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)

# 5-minute windows every 30 seconds: each event lies in ten of them.
SQL_SLIDING = f"""(SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, job, COUNT(*) AS requests,
  COUNT(*) FILTER (error IS NOT NULL) AS errors FROM (
  SELECT *, time_bucket(INTERVAL 30 SECOND, ts) - to_seconds(30 * unnest(range(10))) AS w FROM {SQL_LOG})
  GROUP BY 1, 2, 3)"""


def _rates(t: Tables) -> DataFrame:
    return V.rates(t.prediction_log(), "ts", ["job"], F.col("error").isNotNull())


@query(f"""SELECT window_start, window_end, job, requests, errors, CAST(requests AS DOUBLE) / 300 AS rate,
CAST(errors AS DOUBLE) / requests AS error_ratio FROM {SQL_SLIDING}""")
def sliding_rate(t: Tables) -> DataFrame:
    return _rates(t)


@query(f"""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE
AS window_end, model_name, COUNT(*) AS requests, COUNT(*) FILTER (error IS NOT NULL) AS errors,
CAST(COUNT(*) AS DOUBLE) / 300 AS rate, CAST(COUNT(*) FILTER (error IS NOT NULL) AS DOUBLE) / COUNT(*) AS error_ratio
FROM {SQL_LOG} GROUP BY 1, 2, 3""")
def prediction_rate(t: Tables) -> DataFrame:
    return V.rates(t.prediction_log(), "ts", ["model_name"], F.col("error").isNotNull(), 300, 300)


def _quantile_sql(width: str) -> str:
    names = [f"b{i}" for i in range(len(BOUNDS) + 1)]
    lows = (0.0, *BOUNDS)
    counts = ", ".join(
        f"COUNT(*) FILTER (latency_ms > {lo} AND latency_ms <= {hi}) AS b{i}" if i else
        f"COUNT(*) FILTER (latency_ms <= {hi}) AS b{i}"
        for i, (lo, hi) in enumerate(zip(lows, BOUNDS))) + f", COUNT(*) FILTER (latency_ms > {BOUNDS[-1]}) AS {names[-1]}"
    cases = ""
    for i, (lo, hi) in enumerate(zip(lows, BOUNDS)):
        below = " + ".join(names[:i]) or "0"
        cases += (f" WHEN {below} + b{i} >= r AND b{i} > 0 THEN CAST({lo} AS DOUBLE) + CAST({hi - lo} AS DOUBLE) * "
                  f"(CAST(r - ({below}) AS DOUBLE) / b{i})")
    return f"""SELECT window_start, window_start + INTERVAL {width} AS window_end, job,
      CASE {cases} ELSE {BOUNDS[-1]} END AS latency FROM (
      SELECT *, CAST(0.95 AS DOUBLE) * ({' + '.join(names)}) AS r FROM (
        SELECT time_bucket(INTERVAL {width}, ts) AS window_start, job, {counts} FROM {SQL_LOG} GROUP BY 1, 2))"""


@query(_quantile_sql("5 MINUTE"))
def p95_latency(t: Tables) -> DataFrame:
    return V.latency_quantile(t.prediction_log(), "ts", ["job"], "latency_ms", 0.95, BOUNDS)


@query(_quantile_sql("1 DAY"))
def p95_latency_daily(t: Tables) -> DataFrame:
    return V.latency_quantile(t.prediction_log(), "ts", ["job"], "latency_ms", 0.95, BOUNDS, 86_400, 86_400)


@query(f"""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE
AS window_end, job, quantile_disc(latency_ms, 0.95) AS latency FROM {SQL_LOG} GROUP BY 1, 2, 3""")
def p95_latency_sketch(t: Tables) -> DataFrame:
    return V.latency_quantile_sketch(t.prediction_log(), "ts", ["job"], "latency_ms")


_LATENCY_BARS = " || ',' || ".join(
    f"COUNT(*) FILTER ({c})" for c in (
        ["latency_ms <= 5.0"] + [f"latency_ms > {a} AND latency_ms <= {b}" for a, b in zip(BOUNDS, BOUNDS[1:])]
        + ["latency_ms > 250.0"]))


@query(f"""SELECT model_name, model_version, COUNT(*) AS predictions, COUNT(error) AS errors,
ROUND(SUM(latency_ms), 2) AS latency_sum, {_LATENCY_BARS} AS latency_buckets,
arg_max(drift_score, ts) FILTER (drift_score IS NOT NULL) AS drift_score FROM {SQL_LOG} GROUP BY 1, 2""")
def prediction_metrics(t: Tables) -> DataFrame:
    got = V.prediction_metrics(t.prediction_log(), BOUNDS)
    return (got.withColumn("latency_sum", F.round("latency_sum", 2))
            .withColumn("latency_buckets", F.array_join("latency_buckets", ",")))


@query(f"""SELECT model_name, model_version, bucket, CASE bucket WHEN 0 THEN 10.0e0 WHEN 1 THEN 100.0e0 END AS le, COUNT(*) AS n
FROM (SELECT *, CASE WHEN p <= 10 THEN 0 WHEN p <= 100 THEN 1 ELSE 2 END AS bucket FROM (
SELECT model_name, model_version, unnest([prediction, prediction * 2]) AS p FROM {SQL_LOG})) GROUP BY 1, 2, 3""")
def prediction_values(t: Tables) -> DataFrame:
    log = t.prediction_log().withColumn("prediction", F.array("prediction", F.col("prediction") * 2))
    return V.prediction_values(log, (10.0, 100.0))


@query(f"""SELECT request_id, model_name, model_version, ts, CAST(user_id AS DOUBLE) AS tenure, prediction, error FROM {SQL_LOG}""")
def prediction_topic(t: Tables) -> DataFrame:
    """Predictions read back from the messages of a prediction topic."""
    log = t.prediction_log()
    body = F.struct("request_id", "model_name", "model_version",
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                    F.struct(F.col("user_id").cast("double").alias("tenure")).alias("features"),
                    "prediction", "latency_ms", "error")
    messages = log.select(F.to_json(body).alias("value"))
    got = predictions(messages, T.StructType([T.StructField("tenure", T.DoubleType())]))
    return got.select("request_id", "model_name", "model_version", F.col("ts").cast("timestamp_ntz").alias("ts"),
                      "features.tenure", "prediction", "error")


@query(f"""SELECT model_name, COUNT(*) AS requests, COUNT(*) FILTER (error IS NULL) AS successes,
CAST(COUNT(*) FILTER (error IS NULL) AS DOUBLE) / COUNT(*) * 100 AS success_rate,
ROUND(AVG(latency_ms) FILTER (error IS NULL), 4) AS avg_latency_ms FROM {SQL_LOG} GROUP BY 1""")
def client_summary(t: Tables) -> DataFrame:
    return V.client_summary(t.prediction_log(), ["model_name"]).withColumn("avg_latency_ms", F.round("avg_latency_ms", 4))


@query("""SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(length('{"user_id":' || user_id || ',"kind":"' || event_type || '"}') AS INTEGER) AS input_size,
'list' AS result_type, CAST(length('[' || user_id || ',1]') AS INTEGER) AS result_size, value AS latency_ms FROM events""")
def request_log(t: Tables) -> DataFrame:
    micros = F.round(F.col("value") * 1000).cast("bigint")
    rows = t.events().select(
        F.col("event_id").cast("string").alias("request_id"),
        F.struct("user_id", F.col("event_type").alias("kind")).alias("features"),
        F.array(F.col("user_id"), F.lit(1).cast("bigint")).alias("prediction"), F.col("ts").cast("timestamp").alias("started_at"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + micros).alias("ended_at"))
    return V.request_log(rows).drop("input_bytes")


# alerts ----------------------------------------------------------------------
def _episodes_sql(series: str, labels: str, moment: str, value: str, threshold: float, hold: int, step: int,
                  name: str, severity: str) -> str:
    return f"""SELECT {labels}, MIN({moment}) AS started_at, MAX({moment}) AS last_at, COUNT(*) AS evaluations,
      MAX({value}) AS peak, CAST(epoch_us(MAX({moment})) - epoch_us(MIN({moment})) AS DOUBLE) / 1e6 AS held_seconds,
      (epoch_us(MAX({moment})) - epoch_us(MIN({moment}))) / 1e6 >= {hold} AS fired, '{name}' AS alert, '{severity}' AS severity
      FROM (SELECT *, epoch_us({moment}) // {step * 1000000} - row_number() OVER (PARTITION BY {labels} ORDER BY {moment}) AS run
            FROM ({series}) WHERE {value} > {threshold}) GROUP BY {labels}, run"""


@query(_episodes_sql(f"SELECT *, CAST(errors AS DOUBLE) / requests AS error_ratio FROM {SQL_SLIDING}", "job", "window_end",
                     "error_ratio", 0.05, 300, 30, "HighErrorRate", "critical"))
def alert_error_rate(t: Tables) -> DataFrame:
    return A.episodes(_rates(t), ["job"], "window_end", "error_ratio", A.RULES["HighErrorRate"], 30)


SLOW = A.AlertRule("SlowResponseTime", 20.0, 86_400 * 2)


@query("SELECT * FROM (" + _episodes_sql(_quantile_sql("1 DAY"), "job", "window_end", "latency", 20.0, 86_400 * 2, 86_400,
                                         "SlowResponseTime", "warning") + ") WHERE fired")
def alert_slow_response(t: Tables) -> DataFrame:
    series = V.latency_quantile(t.prediction_log(), "ts", ["job"], "latency_ms", 0.95, BOUNDS, 86_400, 86_400)
    return A.firing(series, ["job"], "window_end", "latency", SLOW, 86_400)


SQL_DRIFT_SERIES = f"""SELECT model_name, time_bucket(INTERVAL 5 MINUTE, ts) AS seen_at, MAX(drift_score) * 20 AS drift
FROM {SQL_LOG} WHERE drift_score IS NOT NULL GROUP BY 1, 2"""


@query(_episodes_sql(SQL_DRIFT_SERIES, "model_name", "seen_at", "drift", 0.5, 1800, 300, "ModelDrift", "warning"))
def alert_model_drift(t: Tables) -> DataFrame:
    series = (t.prediction_log().filter(F.col("drift_score").isNotNull())
              .groupBy("model_name", F.window("ts", "5 minutes")["start"].alias("seen_at"))
              .agg((F.max("drift_score") * 20).alias("drift")))
    return A.episodes(series, ["model_name"], "seen_at", "drift", A.RULES["ModelDrift"], 300)


SQL_RATIO = """SELECT a.pod, a.hour, a.u AS usage, b.l AS "limit", a.u / b.l AS ratio FROM
 (SELECT user_id % 20 AS pod, time_bucket(INTERVAL 1 HOUR, ts) AS hour, SUM(CAST(value AS DECIMAL(12,2)))::DOUBLE AS u
  FROM events GROUP BY 1, 2) a JOIN
 (SELECT c_custkey % 20 AS pod, SUM(CAST(abs(c_acctbal) AS DECIMAL(12,2)))::DOUBLE / 1000 AS l FROM customer GROUP BY 1) b
 ON a.pod = b.pod"""


def _usage(t: Tables) -> DataFrame:
    usage = t.events().select((F.col("user_id") % 20).alias("pod"), F.window("ts", "1 hour")["start"].alias("hour"),
                              F.col("value").cast("decimal(12,2)").alias("value"))
    limits = t.raw("customer").select((F.col("c_custkey") % 20).alias("pod"),
                                      F.abs("c_acctbal").cast("decimal(12,2)").alias("value"))
    per_hour = usage.groupBy("pod", "hour").agg(F.sum("value").cast("double").alias("value"))
    limit = limits.groupBy("pod").agg((F.sum("value").cast("double") / 1000).alias("value"))
    hours = per_hour.select("pod", "hour").distinct().join(limit, "pod")
    return V.usage_ratio(per_hour, hours, ("pod", "hour"))


@query(SQL_RATIO)
def usage_ratio(t: Tables) -> DataFrame:
    return _usage(t)


@query(_episodes_sql(SQL_RATIO, "pod", "hour", "ratio", 0.01, 600, 3600, "HighCPUUsage", "warning"))
def alert_usage(t: Tables) -> DataFrame:
    rule = A.AlertRule("HighCPUUsage", 0.01, 600)
    return A.episodes(_usage(t), ["pod"], "hour", "ratio", rule, 3600)


@query("""SELECT 'group-' || (user_id % 4) AS consumergroup, event_type AS topic,
CAST(SUM(GREATEST(event_id - COALESCE(CASE WHEN event_id % 3 <> 0 THEN event_id - user_id END, 0), 0)) AS BIGINT) AS lag
FROM events GROUP BY 1, 2""")
def consumer_lag(t: Tables) -> DataFrame:
    offsets = t.events().select(
        F.concat(F.lit("group-"), F.col("user_id") % 4).alias("consumergroup"), F.col("event_type").alias("topic"),
        F.col("event_id").alias("partition"), F.col("event_id").alias("latest"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") - F.col("user_id")).alias("committed"))
    return V.consumer_lag(offsets)


@query(_episodes_sql("""SELECT event_type AS topic, time_bucket(INTERVAL 5 MINUTE, ts) AS seen_at, MAX(value) * 100 AS lag FROM events
GROUP BY 1, 2""", "topic", "seen_at", "lag", 1000.0, 900, 300, "KafkaConsumerLag", "warning"))
def alert_consumer_lag(t: Tables) -> DataFrame:
    series = (t.events().groupBy(F.col("event_type").alias("topic"), F.window("ts", "5 minutes")["start"].alias("seen_at"))
              .agg((F.max("value") * 100).alias("lag")))
    return A.episodes(series, ["topic"], "seen_at", "lag", A.RULES["KafkaConsumerLag"], 300)


@query("""SELECT event_id FROM events WHERE ('0x' || substr(md5('22' || event_id), 1, 8))::BIGINT % 10000 < 2000""")
def sample_traces(t: Tables) -> DataFrame:
    return t.events().filter(in_sample(F.col("event_id"), 20, 22)).select("event_id")


@query("""SELECT event_id, metric, 'serving' AS "service.name", COALESCE(CASE WHEN event_id % 2 = 0 THEN 'test' END, 'prod') AS environment
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'http_requests_total' WHEN event_type = 'view' THEN 'system.cpu.time'
ELSE event_type END AS metric FROM events) WHERE metric IN ('http_requests_total', 'system.cpu.time')""")
def allowed_metrics(t: Tables) -> DataFrame:
    samples = t.events().select(
        "event_id", F.when(F.col("event_type") == "error", "http_requests_total")
        .when(F.col("event_type") == "view", "system.cpu.time").otherwise(F.col("event_type")).alias("metric"),
        F.when(F.col("event_id") % 2 == 0, "test").alias("environment"))
    return V.with_attributes(V.allowed_metrics(samples), {"service.name": "serving", "environment": "prod"})
