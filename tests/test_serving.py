import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from featloom.functions.hashing import hash_bucket, in_sample
from featloom.plans import alerts as A, models as M, serving as V

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def log(spark):
    r = random.Random(1)
    rows = [(at(r.randrange(3600)), "hot" if i % 3 else "cold", "boom" if r.random() < 0.1 else None, r.random() * 120)
            for i in range(2000)]
    return rows, spark.createDataFrame(rows, "ts timestamp_ntz, job string, error string, latency_ms double")


def test_sliding_rates(log):
    rows, df = log
    got = V.rates(df, "ts", ["job"], F.col("error").isNotNull(), 300, 30).collect()
    seen = {(r["job"], r["window_start"]): r for r in got}
    for (job, start), r in list(seen.items())[::17]:
        mine = [x for x in rows if x[1] == job and start <= x[0] < start + dt.timedelta(seconds=300)]
        bad = sum(x[2] is not None for x in mine)
        assert (r["requests"], r["errors"]) == (len(mine), bad)
        assert r["rate"] == len(mine) / 300 and r["error_ratio"] == bad / len(mine)


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(at(1), "a", float(x)) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 200]], "ts timestamp_ntz, job string, ms double")
    q = lambda p: V.latency_quantile(df, "ts", ["job"], "ms", p, (5.0, 10.0, 100.0)).first()["latency"]
    assert q(0.5) == 5.0 and q(0.7) == 7.5 and q(0.99) == 100.0 and q(0.25) == 2.5


def test_histogram(spark, rows):
    df = spark.createDataFrame([("m", 1.0), ("m", 5.0), ("m", 7.0), ("m", 1e9), ("m", None)], "m string, v double")
    assert rows(V.histogram(df, ["m"], "v", (5.0, 10.0)), "bucket") == [("m", 0, 5.0, 2), ("m", 1, 10.0, 1), ("m", 2, None, 1)]


def test_client_summary(spark):
    df = spark.createDataFrame([(None, 10.0), (None, 20.0), ("x", 99.0)], "error string, latency_ms double")
    r = V.client_summary(df).first()
    assert (r["requests"], r["successes"], r["avg_latency_ms"]) == (3, 2, 15.0) and r["success_rate"] == pytest.approx(200 / 3)


def test_lag_and_ratio(spark, rows):
    offsets = spark.createDataFrame([("g", "t", 0, 100, 40), ("g", "t", 1, 50, None), ("g", "u", 0, 5, 9)],
                                    "consumergroup string, topic string, partition int, latest bigint, committed bigint")
    assert sorted(rows(V.consumer_lag(offsets))) == [("g", "t", 110), ("g", "u", 0)]
    usage = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("q", 1.0), ("z", 1.0)], "pod string, value double")
    limits = spark.createDataFrame([("p", 6.0), ("q", 0.0)], "pod string, value double")
    assert sorted(rows(V.usage_ratio(usage, limits)))[0] == ("p", 3.0, 6.0, 0.5)
    assert {r["pod"]: r["ratio"] for r in V.usage_ratio(usage, limits).collect()} == {"p": 0.5, "q": None}


def test_attributes(spark, rows):
    df = spark.createDataFrame([("http_requests_total", None), ("other", "x")], "metric string, env string")
    assert rows(V.with_attributes(V.allowed_metrics(df), {"env": "prod", "svc": "s"})) == [("http_requests_total", "prod", "s")]


def test_prediction_metrics(spark):
    rows = [("m", "1", at(1), 4.0, None, 0.1), ("m", "1", at(3), 40.0, "e", 0.9), ("m", "1", at(5), None, None, None), ("m", "2", at(1), 1.0, None, None)]
    df = spark.createDataFrame(rows, "model_name string, model_version string, ts timestamp_ntz, latency_ms double, error string, drift_score double")
    got = {r["model_version"]: r for r in V.prediction_metrics(df, (5.0, 50.0)).collect()}
    assert (got["1"]["predictions"], got["1"]["errors"], got["1"]["latency_sum"], got["1"]["drift_score"]) == (3, 1, 44.0, 0.9)
    assert got["1"]["latency_buckets"] == [1, 1, 0] and got["2"]["drift_score"] is None


# alerts ------------------------------------------------------------------------
def test_alert_holds(spark):
    rule = A.AlertRule("r", 0.5, 120)
    series = [("a", 0, 0.9), ("a", 60, 0.6), ("a", 120, 0.7), ("a", 180, 0.1), ("a", 240, 0.9),
              ("b", 0, 0.9), ("b", 60, 0.5), ("b", 120, 0.9),                   # equal to the threshold is no breach
              ("c", 0, 0.9), ("c", 60, 0.9), ("c", 180, 0.9), ("c", 240, 0.9)]   # a missing step ends the run
    df = spark.createDataFrame([(k, at(s), v) for k, s, v in series], "pod string, at timestamp_ntz, v double")
    got = sorted((r["pod"], r["started_at"], r["held_seconds"], r["evaluations"], r["fired"])
                 for r in A.episodes(df, ["pod"], "at", "v", rule, 60).collect())
    assert got == [("a", at(0), 120.0, 3, True), ("a", at(240), 0.0, 1, False), ("b", at(0), 0.0, 1, False),
                   ("b", at(120), 0.0, 1, False), ("c", at(0), 60.0, 2, False), ("c", at(180), 60.0, 2, False)]
    assert [r["pod"] for r in A.firing(df, ["pod"], "at", "v", rule, 60).collect()] == ["a"]


def test_rules():
    assert {n: (r.threshold, r.hold_seconds) for n, r in A.RULES.items()} == {
        "HighErrorRate": (0.05, 300), "SlowResponseTime": (2.0, 300), "ModelDrift": (0.5, 1800),
        "HighCPUUsage": (0.85, 600), "HighMemoryUsage": (0.85, 600), "KafkaConsumerLag": (1000.0, 900)}


# models ------------------------------------------------------------------------
def test_split(spark):
    ids = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("id"))
    one = {r["id"]: r["arm"] for r in M.assign(ids, "id").collect()}
    two = {r["id"]: r["arm"] for r in M.assign(ids.repartition(3), "id").collect()}
    assert one == two
    assert sum(a == "B" for a in one.values()) / len(one) == pytest.approx(0.2, abs=0.01)
    other = {r["id"]: r["arm"] for r in M.assign(ids, "id", salt="next").collect()}
    assert other != one
    three = M.assign(ids, "id", {"A": 0.5, "B": 0.3, "C": 0.2}, method="xxhash64").groupBy("arm").count().collect()
    assert {r["arm"] for r in three} == {"A", "B", "C"} and sum(r["count"] for r in three) == 20_000
    literal = M.assign(ids, "id", mode="regex").filter("arm = 'B'").count() / 20_000
    assert literal == pytest.approx(0.909, abs=0.01)
    with pytest.raises(ValueError):
        M.assign(ids, "id", {"A": 0.5})


def test_sampling_is_per_trace(spark):
    df = spark.range(20_000)
    share = df.filter(in_sample(F.col("id"), 5)).count() / 20_000
    assert share == pytest.approx(0.05, abs=0.01)
    assert df.filter(in_sample(F.col("id"), 5) & ~in_sample(F.col("id"), 20)).count() == 0
    b = df.select(hash_bucket(F.col("id"), 10, method="xxhash64").alias("b")).agg(F.min("b"), F.max("b")).first()
    assert tuple(b) == (0, 9)


def test_score_and_errors(spark):
    def predict(x):
        if (x["f"] < 0).any():
            raise ValueError("negative input")
        return x["f"] * 2
    df = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, 3.0)], "id int, f double")
    got = {r["id"]: r for r in M.score(df.coalesce(1), predict, ["f"], "m", "7").collect()}
    assert (got[1]["prediction"], got[3]["prediction"], got[2]["prediction"]) == (2.0, 6.0, None)
    assert got[2]["error"] == "negative input" and got[1]["error"] is None and got[1]["latency_ms"] >= 0
    assert got[1]["model_version"] == "7"
    facts = M.prediction_facts(M.score(df, lambda x: x["f"], ["f"], "m", "7"), "id", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert facts.filter("entity_id = '1'").first()["model_id"] == "m:7"


def test_score_odd_models(spark):
    df = spark.range(64).selectExpr("id", "cast(id as double) f", "array(id) untouched").coalesce(1)
    short = M.score(df, lambda x: x["f"].iloc[1:] if len(x) > 1 else x["f"], ["f"], "m", "1").collect()
    assert [r["prediction"] for r in short] == [r["f"] for r in short] and short[0]["untouched"] == [0]
    calls = spark.sparkContext.accumulator(0)

    def broken(x):
        calls.add(1)
        raise ValueError("never works")
    got = M.score(df, broken, ["f"], "m", "1", give_up=5).collect()
    assert {r["error"] for r in got} == {"never works"} and {r["prediction"] for r in got} == {None} and calls.value < 30
    plan = M.score(df, broken, ["f"], "m", "1")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    texts = M.score(df.limit(2), lambda x: ["a", None], ["f"], "m", "1", "string").collect()
    assert [r["prediction"] for r in texts] == ["a", None]


def test_resolve(spark):
    registry = spark.createDataFrame([("m", 1, "Production"), ("m", 2, "Production"), ("m", 3, "Staging")], "name string, version int, stage string")
    asked = spark.createDataFrame([(1, "m", "production"), (2, "m", "3"), (3, "m", "9"), (4, "m", "canary"), (5, "m", "Archived"), (6, "x", "None")],
                                  "id int, model_name string, version_or_stage string")
    got = {r["id"]: (r["version"], r["error"]) for r in M.resolve(asked, registry).collect()}
    assert got == {1: (2, None), 2: (3, None), 3: (None, "Model version not found: 9"), 4: (None, "Invalid stage name: canary"),
                   5: (None, "No model version found with stage Archived"), 6: (None, "No model version found with stage None")}
