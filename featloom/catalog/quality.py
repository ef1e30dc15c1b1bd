"""Expectation suites, profiles, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.catalog.base import EVENTS_AS_OF, Tables, query
from featloom.plans import drift, profile, profile_state, quality as Q
from featloom.session import scratch_dir

SPLIT = "TIMESTAMP '2024-01-16'"

EVENTS_SUITE = Q.make_suite("events", [
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "event_id"}},
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "event_id"}},
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "user_id"}},
    {"expectation_type": "expect_column_values_to_be_in_set",
     "kwargs": {"column": "event_type", "value_set": ["view", "click", "purchase", "signup"], "mostly": 0.75}},
    {"expectation_type": "expect_column_values_to_be_between",
     "kwargs": {"column": "value", "min_value": 1.0, "max_value": 100.0, "mostly": 0.95}},
    {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "props", "regex": "^\\{\"k\": \\d+\\}$"}},
    {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 500}},
    {"expectation_type": "expect_column_max_to_be_between", "kwargs": {"column": "value", "max_value": 1000.0}},
    {"expectation_type": "expect_column_min_to_be_between", "kwargs": {"column": "value", "min_value": 0.5}},
    {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "ts"}},
    {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "nope"}},
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "nope"}},
])

EMPTY = "CAST(NULL AS BIGINT)"


def _row(i: int, kind: str, column: str, success: str, n: str = EMPTY, u: str = EMPTY, seen: str = "CAST(NULL AS DOUBLE)",
         error: str = "CAST(NULL AS VARCHAR)") -> str:
    return (f"SELECT {i} AS position, '{kind}' AS expectation_type, {column} AS column_name, {success} AS success, "
            f"{n} AS element_count, {u} AS unexpected_count, CAST({u} AS DOUBLE) / {n} * 100 AS unexpected_percent, "
            f"{seen} AS observed_value, {error} AS error FROM a")


SQL_EVENTS_CHECKS = """WITH a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (event_id IS NULL) AS u0,
 COUNT(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'signup')) AS u3,
 COUNT(*) FILTER (NOT (value >= 1 AND value <= 100)) AS u4, MIN(value) AS lo, MAX(value) AS hi,
 (SELECT CAST(COALESCE(SUM(c) FILTER (c > 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS c FROM events GROUP BY event_id)) AS u1,
 (SELECT CAST(COALESCE(SUM(c) FILTER (c > 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS c FROM events GROUP BY user_id)) AS u2
 FROM events) """ + " UNION ALL ".join([
    _row(0, "expect_column_values_to_not_be_null", "'event_id'", "u0 = 0", "n", "u0"),
    _row(1, "expect_column_values_to_be_unique", "'event_id'", "u1 = 0", "n", "u1"),
    _row(2, "expect_column_values_to_be_unique", "'user_id'", "u2 = 0", "n", "u2"),
    _row(3, "expect_column_values_to_be_in_set", "'event_type'", "1 - CAST(u3 AS DOUBLE) / n >= 0.75", "n", "u3"),
    _row(4, "expect_column_values_to_be_between", "'value'", "1 - CAST(u4 AS DOUBLE) / n >= 0.95", "n", "u4"),
    _row(5, "expect_column_values_to_match_regex", "'props'", "true", "n", "CAST(0 AS BIGINT)"),
    _row(6, "expect_table_row_count_to_be_between", "CAST(NULL AS VARCHAR)", "n >= 500", seen="CAST(n AS DOUBLE)"),
    _row(7, "expect_column_max_to_be_between", "'value'", "hi <= 1000", seen="hi"),
    _row(8, "expect_column_min_to_be_between", "'value'", "lo >= 0.5", seen="lo"),
    _row(9, "expect_column_to_exist", "'ts'", "true"),
    _row(10, "expect_column_to_exist", "'nope'", "false"),
    _row(11, "expect_column_values_to_not_be_null", "'nope'", "false", error="'column nope not found'"),
])


@query(SQL_EVENTS_CHECKS)
def dq_events(t: Tables) -> DataFrame:
    return Q.validate(t.events(), EVENTS_SUITE).drop("suite")


BROKEN_SUITE = Q.make_suite("broken", [
    {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "event_type", "min_value": 5}},
    {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "event_type"}},
    {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "props", "regex": "("}},
    {"expectation_type": "expect_column_mean_to_be_between", "kwargs": {"column": "props", "min_value": 1}},
    {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "user_id", "value_set": ["one", 1]}},
    {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "ts", "min_value": "2024-01-16 00:00:00", "mostly": 0.1}},
])


@query("""WITH a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (user_id <> 1) AS u, COUNT(*) FILTER (ts < TIMESTAMP '2024-01-16') AS t FROM events)
SELECT unnest(range(6))::INTEGER AS position, unnest([false, false, false, false, u = 0, 1 - CAST(t AS DOUBLE) / n >= 0.1]) AS success,
unnest([NULL, NULL, NULL, NULL, u, t]) AS unexpected_count, unnest([true, true, true, true, false, false]) AS has_error FROM a""")
def dq_contained(t: Tables) -> DataFrame:
    """Expectations that cannot be evaluated are rows, and the others are still evaluated."""
    got = Q.validate(t.events(), BROKEN_SUITE)
    return got.select("position", "success", "unexpected_count", F.col("error").isNotNull().alias("has_error"))


@query(f"""SELECT 'events' AS suite, COUNT(*) AS evaluated_expectations, COUNT(*) FILTER (success) AS successful_expectations,
COUNT(*) FILTER (NOT success) AS unsuccessful_expectations, bool_and(success) AS success FROM ({SQL_EVENTS_CHECKS})""")
def dq_summary(t: Tables) -> DataFrame:
    return Q.summary(Q.validate(t.events(), EVENTS_SUITE))


CUSTOMER_SUITE = Q.make_suite("customer", [
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "c_custkey"}},
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "c_nationkey"}},
    {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "c_acctbal", "min_value": 0.0}},
    {"expectation_type": "expect_column_mean_to_be_between", "kwargs": {"column": "c_nationkey", "min_value": 5, "max_value": 20}},
])


@query("""WITH a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (c_acctbal < 0) AS u2, CAST(SUM(c_nationkey) AS DOUBLE) / COUNT(*) AS m,
 (SELECT CAST(COALESCE(SUM(c) FILTER (c > 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS c FROM customer GROUP BY c_custkey)) AS u0,
 (SELECT CAST(COALESCE(SUM(c) FILTER (c > 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS c FROM customer GROUP BY c_nationkey)) AS u1
 FROM customer) SELECT b.*, 'spark_batch_7_20240131_000000' AS run_name FROM (""" + " UNION ALL ".join([
    _row(0, "expect_column_values_to_be_unique", "'c_custkey'", "u0 = 0", "n", "u0"),
    _row(1, "expect_column_values_to_be_unique", "'c_nationkey'", "u1 = 0", "n", "u1"),
    _row(2, "expect_column_values_to_be_between", "'c_acctbal'", "u2 = 0", "n", "u2"),
    _row(3, "expect_column_mean_to_be_between", "'c_nationkey'", "m >= 5 AND m <= 20", seen="m"),
]) + ") b")
def dq_customer(t: Tables) -> DataFrame:
    return Q.validate_batch("7", t.raw("customer"), CUSTOMER_SUITE, EVENTS_AS_OF).drop("suite", "batch_id", "run_at")


def _profile_sql(table: str, columns: list[str]) -> str:
    def one(c: str) -> str:
        width = f"((SELECT MAX({c}) - MIN({c}) FROM {table}) / 10.0e0)"
        low = f"(SELECT MIN({c}) FROM {table})"
        step = f"LEAST(CAST(FLOOR(({c} - {low}) / {width}) AS BIGINT), 9)"
        bars = " || ',' || ".join(f"COUNT(*) FILTER ({step} = {b})" for b in range(10))
        return (f"SELECT '{c}' AS column_name, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, "
                f"ROUND(AVG({c}), 4) AS mean, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, "
                f"ROUND(stddev_samp({c}), 4) AS stddev, COUNT(DISTINCT {c}) AS unique_count, "
                f"CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100 AS missing_percentage, "
                f"{bars} AS histogram FROM {table}")
    return " UNION ALL ".join(one(c) for c in columns)


def _readable(profiled: DataFrame) -> DataFrame:
    for c in ("mean", "median", "stddev"):
        profiled = profiled.withColumn(c, F.round(c, 4))
    return profiled.withColumn("histogram", F.array_join("histogram", ","))


@query(_profile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def profile_lineitem(t: Tables) -> DataFrame:
    return _readable(profile.profile(t.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(_profile_sql("events", ["value", "user_id"]))
def profile_events(t: Tables) -> DataFrame:
    return _readable(profile.profile(t.events(), ["value", "user_id"]))


#: Column -> digits of mean and deviation that are compared; None for texts.
ADDED = {"l_quantity": 8, "l_extendedprice": 4, "l_discount": 8, "l_returnflag": None}


def _added_sql(c: str, digits: int | None) -> str:
    numbers = (f"MIN({c})", f"MAX({c})", f"ROUND(AVG({c}), {digits})", f"ROUND(STDDEV_SAMP({c}), {digits})")
    low, high, mean, stddev = numbers if digits else ("CAST(NULL AS DOUBLE)",) * 4
    return f"""SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT({c}) AS "values", {low} AS min, {high} AS max,
{mean} AS mean, {stddev} AS stddev, 0e0 AS missing_percentage FROM lineitem"""


@query(" UNION ALL ".join(_added_sql(c, digits) for c, digits in ADDED.items()))
def profile_batches(t: Tables) -> DataFrame:
    """The profile of three batches from what each of them left, one batch being told twice."""
    state = profile_state.ProfileState.create(t.spark, scratch_dir(t.spark, "profile"))
    for batch in (0, 1, 1, 2):
        state.add(t.raw("lineitem").where(F.pmod("l_orderkey", F.lit(3)) == batch), list(ADDED), batch)
    def shown(c: str):
        return F.coalesce(*[F.when(F.col("column_name") == name, F.round(c, digits)) for name, digits in ADDED.items() if digits]).alias(c)
    return state.profile().select("column_name", "n_rows", "values", "min", "max", shown("mean"), shown("stddev"), "missing_percentage")


@query("""SELECT 'event_type' AS column_name, COUNT(DISTINCT event_type) AS unique_count, 0e0 AS missing_percentage FROM events
UNION ALL SELECT 'props', COUNT(DISTINCT props), 0e0 FROM events
UNION ALL SELECT 'big', COUNT(DISTINCT event_id), 0e0 FROM events
UNION ALL SELECT 'some', COUNT(DISTINCT event_type) FILTER (event_type <> 'view'),
  CAST(COUNT(*) FILTER (event_type = 'view') AS DOUBLE) / COUNT(*) * 100 FROM events""")
def profile_any_type(t: Tables) -> DataFrame:
    """Texts, and whole numbers that doubles cannot tell apart."""
    rows = t.events().select("event_type", "props", (F.col("event_id") + F.lit(2 ** 60)).alias("big"),
                             F.when(F.col("event_type") != "view", F.col("event_type")).alias("some"))
    return profile.profile(rows, rows.columns).select("column_name", "unique_count", "missing_percentage")


def _sides(t: Tables) -> DataFrame:
    rows = t.events().select("ts", F.col("value").alias("monthly_charges"), F.col("user_id").alias("tenure"),
                             F.get_json_object("props", "$.k").cast("int").alias("total_charges"),
                             F.col("event_type").alias("contract_type"))
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    features = ["monthly_charges", "tenure", "total_charges", "contract_type"]
    return drift.both_sides(rows.filter(cut), rows.filter(~cut), features)


NUMERIC = {"monthly_charges": "value", "tenure": "user_id",
           "total_charges": "CAST(json_extract_string(props, '$.k') AS INTEGER)"}


def _psi_sql(feature: str, value: str) -> str:
    return f"""
SELECT '{feature}' AS feature, SUM((pa - pe) * LN(pa / pe)) AS score, CAST(SUM(e) AS BIGINT) AS n_baseline,
       CAST(SUM(a) AS BIGINT) AS n_current FROM (
  SELECT e, a, GREATEST(CAST(e AS DOUBLE) / SUM(e) OVER (), 1e-4) AS pe, GREATEST(CAST(a AS DOUBLE) / SUM(a) OVER (), 1e-4) AS pa FROM (
    SELECT b, COUNT(*) FILTER (ts < {SPLIT}) AS e, COUNT(*) FILTER (ts >= {SPLIT}) AS a
    FROM (SELECT ts, {value} AS b FROM events) GROUP BY b))"""


def _quantile_bucket(value: str) -> str:
    edges = f"""(SELECT quantile_disc({value}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM events
                 WHERE ts < {SPLIT})"""
    return f"len(list_filter({edges}, lambda q: {value} > q))"


SQL_PSI = " UNION ALL ".join(
    [_psi_sql(f, _quantile_bucket(v)) for f, v in NUMERIC.items()] + [_psi_sql("contract_type", "event_type")])
SQL_KS = " UNION ALL ".join(f"""
SELECT '{f}' AS feature, MAX(ABS(ce - ca)) AS score, CAST(MAX(ne) AS BIGINT) AS n_baseline, CAST(MAX(na) AS BIGINT) AS n_current FROM (
  SELECT CAST(SUM(e) OVER (ORDER BY v) AS DOUBLE) / SUM(e) OVER () AS ce, CAST(SUM(a) OVER (ORDER BY v) AS DOUBLE) / SUM(a) OVER () AS ca,
         SUM(e) OVER () AS ne, SUM(a) OVER () AS na FROM (
    SELECT {v} AS v, COUNT(*) FILTER (ts < {SPLIT}) AS e, COUNT(*) FILTER (ts >= {SPLIT}) AS a FROM events GROUP BY 1))"""
                          for f, v in NUMERIC.items())
LIST = list(NUMERIC)


@query(f"SELECT feature, ROUND(score, 6) AS score, n_baseline, n_current FROM ({SQL_PSI})")
def psi_drift(t: Tables) -> DataFrame:
    return drift.psi(_sides(t), LIST, ["contract_type"]).withColumn("score", F.round("score", 6))


@query(f"SELECT feature, ROUND(score, 6) AS score, n_baseline, n_current FROM ({SQL_KS})")
def ks_drift(t: Tables) -> DataFrame:
    return drift.ks(_sides(t), LIST).withColumn("score", F.round("score", 6))


@query(f"SELECT feature, ROUND(score, 6) AS score, n_baseline, n_current FROM ({SQL_KS}) WHERE feature = 'monthly_charges'")
def csv_baseline_drift(t: Tables) -> DataFrame:
    """A baseline kept as CSV text, compared with the current rows."""
    rows = t.events().select("ts", F.col("value").alias("monthly_charges"))
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    text = rows.filter(cut).select(F.to_csv(F.struct("monthly_charges")).alias("line"))
    baseline = text.select(F.from_csv("line", "monthly_charges double").alias("r")).select("r.*")
    sides = drift.both_sides(baseline, rows.filter(~cut), ["monthly_charges"])
    return drift.ks(sides, ["monthly_charges"]).withColumn("score", F.round("score", 6))


@query(f"""SELECT 'customer_churn_model' AS model_name, metric, feature, ROUND(score, 6) AS score,
CASE WHEN n_current >= 1000 THEN score > 0.15 END AS is_drifted FROM (
SELECT 'model_drift_psi' AS metric, * FROM ({SQL_PSI}) UNION ALL SELECT 'model_drift_ks_test', * FROM ({SQL_KS}))""")
def drift_verdict(t: Tables) -> DataFrame:
    return drift.report(_sides(t), drift.CUSTOMER_CHURN).select(
        "model_name", "metric", "feature", F.round("score", 6).alias("score"), "is_drifted")


@query(f"""WITH q AS (SELECT quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM events WHERE ts < {SPLIT}),
base AS (SELECT len(list_filter(edges, lambda e: value > e)) AS b, COUNT(*) AS n FROM events, q WHERE ts < {SPLIT} GROUP BY 1),
cur AS (SELECT ts, len(list_filter(edges, lambda e: value > e)) AS b FROM events, q WHERE ts >= {SPLIT}),
hours AS (SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(i AS INTEGER)) AS w FROM cur, range(24) r(i)),
cells AS (SELECT w, b, COUNT(*) AS a FROM hours JOIN cur ON ts >= w AND ts < w + INTERVAL 24 HOUR GROUP BY 1, 2),
grid AS (SELECT v.w, g.b, COALESCE(n, 0) AS e, COALESCE(a, 0) AS a FROM (SELECT DISTINCT w FROM cells) v
  CROSS JOIN (SELECT CAST(i AS BIGINT) AS b FROM range(10) r(i)) g LEFT JOIN base ON base.b = g.b LEFT JOIN cells ON cells.w = v.w AND cells.b = g.b),
s AS (SELECT w, a, GREATEST(CAST(e AS DOUBLE) / SUM(e) OVER (PARTITION BY w), 1e-4) AS pe,
  GREATEST(CAST(a AS DOUBLE) / SUM(a) OVER (PARTITION BY w), 1e-4) AS pa FROM grid)
SELECT w AS window_start, w + INTERVAL 24 HOUR AS window_end, ROUND(SUM((pa - pe) * LN(pa / pe)), 6) AS score,
CAST(SUM(a) AS BIGINT) AS n_current FROM s GROUP BY w HAVING SUM(a) >= 300""")
def drift_hourly(t: Tables) -> DataFrame:
    rows = t.events().select("ts", "value")
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    known = drift.fit_baseline(rows.filter(cut), "value")
    return drift.hourly_psi(known, rows.filter(~cut), "ts", min_samples=300).withColumn(
        "score", F.round("score", 6))


@query(f"""WITH w AS (SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(i AS INTEGER)) AS w FROM events, range(24) r(i)
  WHERE event_id % 2 = 0 AND ts >= {SPLIT}),
c AS (SELECT w, COUNT(*) AS n FROM w JOIN events ON ts >= w AND ts < w + INTERVAL 24 HOUR AND ts >= {SPLIT} AND event_id % 2 = 0 GROUP BY 1)
SELECT w AS window_start, n AS n_current, ROUND((1 - 1e-4) * LN(1 / 1e-4), 6) AS score FROM c WHERE n >= 100""")
def drift_hourly_edges(t: Tables) -> DataFrame:
    """A baseline without values, and a log in which every other value is no number."""
    value = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.lit(float("nan")))
    rows = t.events().select("ts", value.alias("value"))
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    known = drift.fit_baseline(rows.filter(cut).withColumn("value", F.lit(float("nan"))), "value")
    return drift.hourly_psi(known, rows.filter(~cut), "ts", min_samples=100).select(
        "window_start", "n_current", F.round("score", 6).alias("score"))
