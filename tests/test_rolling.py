"""Features that move on by days, profiles that add up, retention by days: against recomputation on the whole."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from featloom.operators import latest
from featloom.plans import batch_features, maintain, profile_state
from featloom.plans.rolling import RollingCustomers
from featloom.session import scratch_dir
from featloom.sinks.keyed import KeyedTable

PURCHASES = "purchase_id bigint, customer_id bigint, amount decimal(12,2), created_at timestamp_ntz"
DAY0 = dt.date(2024, 3, 1)


@pytest.fixture
def shop(table):
    r = random.Random(7)
    rows = []
    for i in range(400):
        day = DAY0 + dt.timedelta(r.randint(-40, 5))
        at = None if i % 97 == 0 else f"{day} {r.randint(0, 23):02}:15:00"
        rows.append((None if i % 50 == 0 else i, r.choice([1, 1, 1, 2, 3, 4, 5, None]), None if i % 31 == 0 else f"{r.randint(1, 999)}.25", at))
    rows += [(900, 6, "5.00", "2024-01-05 00:00:00"), (901, 7, "1.00", "2024-03-02 00:00:00"), (902, 7, "1.00", "2024-03-02 00:00:00")]
    people = [(i, f"2023-0{i}-01 00:00:00") for i in range(1, 10)] + [(3, "2023-01-09 00:00:00")]
    return table("customer_id bigint, created_at timestamp_ntz", people).cache(), table(PURCHASES, rows).cache()


def of_day(purchases, day):
    return purchases.where(F.to_date("created_at") == F.lit(day))


def test_days_equal_recomputation(spark, shop):
    customers, purchases = shop
    rolling = RollingCustomers.start(purchases, scratch_dir(spark, "rolling"), DAY0, days=7, buckets=4)
    for step in range(5):
        day = DAY0 + dt.timedelta(step)
        rolling.advance(of_day(purchases, day), day)  # the first one is taken in already
        as_of = f"{day + dt.timedelta(1)} 00:00:00"
        arrived = purchases.where((F.col("created_at") < F.lit(as_of).cast("timestamp_ntz")) | F.col("created_at").isNull())
        want = batch_features.customer_features(customers, arrived, as_of, 7)
        got = rolling.features(customers)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        parts = {f.part for f in rolling.by_day.version().folders if f.part}
        assert min(parts) >= (day - dt.timedelta(6)).isoformat()


def test_repeated_and_broken_days(spark, shop):
    customers, purchases = shop
    rolling = RollingCustomers.start(purchases, scratch_dir(spark, "rolling"), DAY0, days=7, buckets=4)
    day = DAY0 + dt.timedelta(1)
    with pytest.raises(ValueError):
        rolling.advance(purchases.limit(0), DAY0 + dt.timedelta(2))
    # the first run breaks between the two tables
    write, rolling.state.write = rolling.state.write, lambda *a, **k: 1 / 0
    with pytest.raises(ZeroDivisionError):
        rolling.advance(of_day(purchases, day), day)
    rolling.state.write = write
    rolling.advance(of_day(purchases, day), day)
    once = sorted(map(tuple, rolling.features(customers).collect()), key=str)
    rolling.advance(of_day(purchases, day), day)
    assert sorted(map(tuple, rolling.features(customers).collect()), key=str) == once
    arrived = purchases.where((F.col("created_at") < "2024-03-03") | F.col("created_at").isNull())
    want = batch_features.customer_features(customers, arrived, "2024-03-03 00:00:00", 7)
    assert once == sorted(map(tuple, want.collect()), key=str)


def test_a_day_touches_only_its_customers(spark, shop):
    _, purchases = shop
    rolling = RollingCustomers.start(purchases.where("customer_id in (2, 3, 4)"), scratch_dir(spark, "rolling"), DAY0, days=60, buckets=8)
    before = rolling.state.version()
    day = DAY0 + dt.timedelta(1)
    rolling.advance(spark.createDataFrame([(1, 2, None, dt.datetime(2024, 3, 2))], PURCHASES), day)
    after = rolling.state.version()
    new = [f for f in after.folders if f not in before.folders]
    assert len(new) == 1 and new[0].rows == 1 and set(before.folders) <= set(after.folders)


def test_nothing_bought(spark, shop):
    customers, purchases = shop
    rolling = RollingCustomers.start(purchases.limit(0), scratch_dir(spark, "rolling"), DAY0)
    rolling.advance(purchases.limit(0), DAY0 + dt.timedelta(1))
    assert {r["customer_purchase_count_30d"] for r in rolling.features(customers).collect()} == {0}


@pytest.fixture
def numbers(spark):
    r = random.Random(3)
    rows = [(i, None if i % 9 == 0 else float("nan") if i % 11 == 0 else r.gauss(1e6, 2), r.choice(["a", "b", None]), None) for i in range(3000)]
    return spark.createDataFrame(rows, "i bigint, x double, t string, e double").repartition(4).cache()


def test_profiles_add_up(spark, numbers):
    columns = ["i", "x", "t", "e"]
    state = profile_state.ProfileState.create(spark, scratch_dir(spark, "profile"))
    for batch, where in enumerate(["i < 10", "i >= 10 AND i < 2000", "i >= 2000", "i < 0"]):
        state.add(numbers.where(where), columns, batch)
    state.add(numbers, columns, 1)  # told again: nothing changes
    got = {r["column_name"]: r for r in state.profile().collect()}
    seen = numbers.select("i", F.nanvl("x", F.lit(None).cast("double")).alias("x"), "t", "e")
    for c in ("i", "x"):
        want = seen.agg(F.count(c), F.min(c), F.max(c), F.avg(c), F.stddev_samp(c), F.countDistinct(c), F.percentile(c, 0.5)).first()
        g = got[c]
        assert (g["n_rows"], g["values"], g["min"], g["max"]) == (3000, *want[:3])
        assert g["mean"] == pytest.approx(want[3], rel=1e-12) and g["stddev"] == pytest.approx(want[4], rel=1e-6)
        assert abs(g["unique_count"] - want[5]) <= 0.06 * want[5]
        rank = seen.where(F.col(c) <= g["median"]).count() / want[0]
        assert abs(rank - 0.5) <= 0.035
        assert g["missing_percentage"] == pytest.approx((3000 - want[0]) / 30)
    assert (got["t"]["unique_count"], got["t"]["min"], got["t"]["median"]) == (2, None, None)
    assert (got["e"]["values"], got["e"]["mean"], got["e"]["stddev"], got["e"]["median"], got["e"]["unique_count"]) == (0, None, None, None, 0)
    assert got["e"]["missing_percentage"] == 100


def test_a_profile_reads_no_earlier_batch(spark, numbers):
    state = profile_state.ProfileState.create(spark, scratch_dir(spark, "profile"))
    state.add(numbers, ["x"], 0)
    row = state.table.scan().first()
    assert len(row["distinct_values"]) + len(row["ranks"]) < 20_000


def test_retention_by_days(spark, table):
    rows = [(f"2024-01-{1 + i % 28:02}" if i % 13 else None, i, f"2024-01-{1 + i % 28:02} {i % 24:02}:00:00" if i % 13 else None) for i in range(300)]
    df = table("day string, id bigint, at timestamp_ntz", rows)
    kept = KeyedTable.create(spark, scratch_dir(spark, "retention"), df.schema, ["day", "id"], buckets=1, leading="day")
    assert maintain.retire(kept, "at", 3, "2024-01-20 11:00:00") == 0  # nothing there
    kept.write(df)
    before = {f.path: f.part for f in kept.version().folders}
    maintain.retire(kept, "at", 10, "2024-01-20 11:30:00")
    want = {(r[1]) for r in rows if r[2] is None or r[2] >= "2024-01-10 11:30:00"}
    assert {r["id"] for r in kept.scan().collect()} == want
    after = {f.path: f.part for f in kept.version().folders}
    # expired days are gone from the log, later ones are the same files, one day was written anew
    assert [after[p] for p in after if p not in before] == ["2024-01-10"]
    assert all(part not in after.values() for part in before.values() if part and part < "2024-01-10")
    number = maintain.retire(kept, "at", 60, "2024-01-20 00:00:00")
    assert {r["id"] for r in kept.scan().collect()} == want and number == kept.version().number
    with pytest.raises(ValueError):
        KeyedTable.create(spark, scratch_dir(spark, "flat"), df.schema, ["id"]).drop_before("x")


def test_latest_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 2, 7, 8), (1, 3, 9, 10)], "k int, o int, _n int, _place int")
    assert [tuple(r) for r in latest.latest_by_key(df, ["k"], ["o"]).collect()] == [(1, 3, 9, 10)]
