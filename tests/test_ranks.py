import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.operators import ranks
from featloom.plans import drift, profile


def _values(kind):
    r = random.Random(5)
    return {
        "even": [r.randrange(500) / 7 for _ in range(800)],
        "heavy": [math.exp(r.gauss(0, 6)) for _ in range(800)],
        "signed": [r.gauss(0, 3) for _ in range(800)] + [0.0, -0.0],
        "bunched": [1.7e9 + r.randrange(2_600_000) for _ in range(800)],
        "one_value": [4.5] * 500 + [r.random() for _ in range(250)],
        "tiny": [r.random() * 1e-30 for _ in range(200)],
    }[kind]


KINDS = ["even", "heavy", "signed", "bunched", "one_value", "tiny"]


@pytest.mark.parametrize("kind", KINDS)
def test_running_totals(spark, kind):
    values = _values(kind)
    df = spark.createDataFrame([("f", float(v)) for v in values], "feature string, v double").repartition(5)
    counts = ranks.value_counts(df, ["feature"], "v", {"n": F.lit(1)})
    got = ranks.running_totals(counts, ["feature"], "v", ["n"]).collect()
    ordered = sorted(values)
    assert len(got) == len(set(values))
    for r in got:
        assert r["cum_n"] == np.searchsorted(ordered, r["v"], side="right")
        assert r["all_n"] == len(values)


@pytest.mark.parametrize("kind", KINDS)
def test_quantiles(spark, kind):
    values = sorted(float(v) for v in _values(kind))
    df = spark.createDataFrame([("f", v) for v in values], "feature string, v double")
    totals = ranks.running_totals(ranks.value_counts(df, ["feature"], "v", {"n": F.lit(1)}), ["feature"], "v", ["n"])
    ps = [0.1, 0.25, 0.5, 0.95]
    row = totals.groupBy("feature").agg(ranks.discrete_quantiles("v", "n", ps).alias("q"),
                                        ranks.interpolated_quantile("v", "n", 0.5, "m")).first()
    assert row["q"] == [values[max(1, math.ceil(round(p * len(values), 9))) - 1] for p in ps]
    assert row["m"] == pytest.approx(np.median(values), rel=1e-12)


def _chunk_sizes(spark, values, kind="double"):
    df = spark.createDataFrame([("f", v) for v in values], f"feature string, v {kind}")
    cut = ranks.chunked(df.withColumn("n", F.lit(1)), ["feature"], "v")
    got = cut.orderBy("v").collect()
    places = [(r["_coarse"], r["_fine"]) for r in got]
    assert places == sorted(places)                        # chunks follow the values
    sizes = {}
    for p in places:
        sizes[p] = sizes.get(p, 0) + 1
    return list(sizes.values())


def test_chunks_follow_the_data(spark):
    """Wherever the distinct values lie, no chunk holds much more than it should."""
    r = random.Random(4)
    bands = {
        "narrow, far from zero": [1.7e15 + i for i in range(30_000)],
        "narrow and fine": [1e9 + i * 1e-5 for i in range(30_000)],
        "heavy above": sorted({1e12 + math.exp(r.gauss(0, 5)) for _ in range(30_000)}),
        "around zero": sorted({r.gauss(0, 1) for _ in range(30_000)}),
    }
    for name, values in bands.items():
        sizes = _chunk_sizes(spark, values)
        assert max(sizes) <= 4 * ranks.CHUNK_VALUES and len(sizes) >= 10, name
    assert max(_chunk_sizes(spark, [2 ** 62 + i for i in range(30_000)], "bigint")) <= 4 * ranks.CHUNK_VALUES


def test_no_window_over_a_whole_feature(spark):
    df = spark.range(1000).select(F.lit("f").alias("feature"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    plan = ranks.running_totals(df, ["feature"], "v", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_coarse" in w for w in windows)


def test_profile_is_exact_beyond_doubles(spark):
    from decimal import Decimal
    rows = [(2 ** 60 + i % 10, Decimal(10 ** 20 + i % 4), "t" if i % 2 else None, [i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "a bigint, b decimal(30,2), c string, d array<int>")
    got = {r["column_name"]: r for r in profile.profile(df, ["a", "b", "c", "d"]).collect()}
    assert {c: got[c]["unique_count"] for c in "abcd"} == {"a": 10, "b": 4, "c": 1, "d": 3}
    assert got["c"]["missing_percentage"] == 50.0 and got["c"]["min"] is None and got["c"]["histogram"] is None
    assert sum(got["a"]["histogram"]) == 40


def test_profile(spark):
    rows = [(float(i % 7), float("nan") if i % 10 == 0 else i / 3, None) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r["column_name"]: r for r in profile.profile(df, ["a", "b", "c"], bins=7).collect()}
    a = np.array([r[0] for r in rows])
    assert got["a"]["mean"] == pytest.approx(a.mean()) and got["a"]["stddev"] == pytest.approx(a.std(ddof=1))
    assert got["a"]["median"] == np.median(a) and got["a"]["unique_count"] == 7
    assert sum(got["a"]["histogram"]) == 200 and got["a"]["histogram"] == list(np.histogram(a, 7)[0])
    assert got["b"]["missing_percentage"] == 10.0 and got["b"]["unique_count"] == 180
    assert got["c"]["missing_percentage"] == 100.0 and got["c"]["unique_count"] == 0 and got["c"]["min"] is None
    near = {r["column_name"]: r for r in profile.profile_approximate(df, ["a", "b"]).collect()}
    assert near["a"]["max"] == 6.0 and near["b"]["missing_percentage"] == 10.0


def test_profile_of_one_value(spark):
    got = profile.profile(spark.createDataFrame([(3.0,)] * 4, "a double"), ["a"]).first()
    assert (got["min"], got["max"], got["median"], got["stddev"]) == (3.0, 3.0, 3.0, 0.0)
    assert got["histogram"][0] == 4


def _brute_psi(e, a, bins=10):
    e, a = sorted(e), sorted(a)
    edges = [e[max(1, math.ceil(round(len(e) * i / bins, 9))) - 1] for i in range(1, bins)]
    bucket = lambda v: sum(v > x for x in edges)
    out = 0.0
    for b in range(bins):
        pe = max(sum(bucket(v) == b for v in e) / len(e), 1e-4)
        pa = max(sum(bucket(v) == b for v in a) / len(a), 1e-4)
        out += (pa - pe) * math.log(pa / pe)
    return out


def test_drift(spark):
    r = random.Random(9)
    base = [(r.gauss(0, 1), float(r.randrange(5)), "x" if r.random() < 0.5 else "y") for _ in range(1500)]
    now = [(r.gauss(0.8, 1), float(r.randrange(5)), "x" if r.random() < 0.9 else None) for _ in range(1200)]
    schema = "u double, w double, kind string"
    sides = drift.both_sides(spark.createDataFrame(base, schema), spark.createDataFrame(now, schema), ["u", "w", "kind"])
    config = drift.DriftConfig("m", ("u", "w"), ("kind",), 0.2, 0.2)
    got = {(r["metric"], r["feature"]): r for r in drift.report(sides, config).collect()}
    assert got["model_drift_psi", "u"]["score"] == pytest.approx(_brute_psi([x[0] for x in base], [x[0] for x in now]))
    e, a = np.sort([x[0] for x in base]), np.sort([x[0] for x in now])
    grid = np.concatenate([e, a])
    ks = np.abs(np.searchsorted(e, grid, "right") / len(e) - np.searchsorted(a, grid, "right") / len(a)).max()
    assert got["model_drift_ks_test", "u"]["score"] == pytest.approx(ks)
    assert got["model_drift_ks_test", "u"]["is_drifted"] and not got["model_drift_ks_test", "w"]["is_drifted"]
    assert got["model_drift_psi", "kind"]["is_drifted"] and ("model_drift_ks_test", "kind") not in got
    few = {r["feature"]: r["is_drifted"] for r in drift.report(sides, config, min_samples=5000).collect()}
    assert set(few.values()) == {None}


def test_no_drift_against_itself(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(500)], "u double")
    row = drift.feature_drift(drift.both_sides(df, df, ["u"]), ["u"]).first()
    assert row["psi"] == 0.0 and row["ks"] == 0.0


def test_hourly_psi(spark):
    import datetime as dt
    start = dt.datetime(2024, 1, 1)
    base = spark.createDataFrame([(float(i % 100),) for i in range(1000)], "u double")
    log = [(start + dt.timedelta(minutes=i), float(i % 100) if i < 1440 else 99.0) for i in range(2880)]
    known = drift.fit_baseline(base, "u")
    assert sum(known.counts) == 1000 and len(known.edges) == 9
    got = drift.hourly_psi(known, spark.createDataFrame(log, "at timestamp_ntz, u double"), "at", min_samples=1000)
    by = {r["window_start"]: r for r in got.collect()}
    assert min(r["n_current"] for r in by.values()) >= 1000
    first, last = by[start], by[start + dt.timedelta(hours=24)]
    assert first["score"] < 0.01 and first["n_current"] == 1440
    assert last["score"] == pytest.approx(_brute_psi([float(i % 100) for i in range(1000)], [99.0] * 1440))


def test_baseline_edges(spark):
    import datetime as dt
    start = dt.datetime(2024, 1, 1)
    nan = float("nan")
    log = spark.createDataFrame([(start + dt.timedelta(minutes=i), nan if i % 2 else float(i % 100)) for i in range(60)], "at timestamp_ntz, u double")
    known = drift.fit_baseline(spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(nan,)] * 50, "u double"), "u")
    assert sum(known.counts) == 100                        # NaN is no value
    assert {r["n_current"] for r in drift.hourly_psi(known, log, "at", min_samples=1).collect()} == {30}
    base = spark.createDataFrame([], "u double")
    empty = drift.fit_baseline(base, "u")
    assert empty.edges == () and sum(empty.counts) == 0
    score = drift.hourly_psi(empty, log, "at", min_samples=1).first()["score"]
    sides = drift.both_sides(base, log, ["u"])
    assert score == pytest.approx(drift.psi(sides, ["u"]).first()["score"])


def test_current_window(table):
    log = table("at timestamp_ntz", [("2024-01-01 00:00:00",), ("2024-01-01 00:00:01",), ("2024-01-02 00:00:00",),
                                     ("2024-01-02 00:00:01",)])
    assert drift.current_window(log, "at", "2024-01-02 00:00:00").count() == 2
