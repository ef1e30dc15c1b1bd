"""Neighbours in time against brute force, with a key that holds a third of all rows."""

import random

import pandas as pd
import pytest

from featloom.operators import intervals as I, latest as L


def _rows(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{r.randrange(20)}"
        out.append((key, pd.Timestamp("1969-12-30") + pd.Timedelta(seconds=r.randrange(6 * 86400)), i))
    return out


def _frame(spark, rows, names):
    return spark.createDataFrame(pd.DataFrame(rows, columns=names)).selectExpr(
        "key", f"cast({names[1]} as timestamp_ntz) {names[1]}", names[2])


@pytest.mark.parametrize("slice_seconds", [60, 3600, 86400 * 400])
def test_next(spark, slice_seconds):
    rows = _rows(1, 900)
    df = _frame(spark, rows, ["key", "at", "id"])
    got = {r["id"]: r["valid_to"] for r in I.with_next(df, ["key"], "at", tiebreak=["id"],
                                                       slice_seconds=slice_seconds).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == key)
        for (_, i), after in zip(mine, [*mine[1:], None]):
            assert got[i] == (after[0].to_pydatetime() if after else None)


def test_equal_starts_never_overlap(table):
    df = table("key string, at timestamp_ntz, v int", [
        ("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:00", 2), ("a", "2024-01-01 00:00:00", 2), ("a", "2024-01-01 00:00:00", None),
        ("a", "2024-01-02 00:00:00", 3), ("a", "2024-01-02 00:00:00", 3), (None, "2024-01-01 00:00:00", 1), ("b", None, 1)])
    got = I.with_next(df, ["key"], "at").collect()
    assert len(got) == 8
    mine = [r for r in got if r["key"] == "a"]
    lasting = [r for r in mine if r["valid_to"] is None or r["valid_to"] > r["at"]]
    assert sorted((str(r["at"])[:10], r["v"], r["valid_to"] and str(r["valid_to"])[:10]) for r in lasting) == [
        ("2024-01-01", 2, "2024-01-02"), ("2024-01-02", 3, None)]
    asked = table("key string, t timestamp_ntz", [("a", "2024-01-01 12:00:00"), ("a", "2024-01-02 00:00:00")])
    facts = I.with_next(df, ["key"], "at").withColumnRenamed("at", "valid_from")
    assert sorted(r["v"] for r in I.valid_at(facts, asked, ["key"], "t").collect()) == [2, 3]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("slice_seconds", [600, 86400])
def test_as_of(spark, strict, slice_seconds):
    history, labels = _rows(2, 700), _rows(3, 500)
    # equal times on both sides
    labels += [(k, t, 10_000 + i) for k, t, i in history[:50]]
    h = _frame(spark, history, ["key", "at", "value"])
    q = _frame(spark, labels, ["key", "asked", "id"])
    out = I.as_of_join(q, h, ["key"], "asked", "at", ["at", "value"], strict, ["value"], slice_seconds)
    assert out.columns == ["key", "asked", "id", "at", "value"]
    got = {r["id"]: r["value"] for r in out.collect()}
    assert len(got) == len(labels)
    for key, t, i in labels:
        known = [(ht, v) for hk, ht, v in history if hk == key and (ht < t if strict else ht <= t)]
        assert got[i] == (max(known)[1] if known else None)


def test_valid_at(table, rows):
    facts = table("key string, v int, valid_from timestamp_ntz, valid_to timestamp_ntz", [
        ("a", 1, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), ("a", 2, "2024-01-02 00:00:00", None)])
    asked = table("key string, at timestamp_ntz", [
        ("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("a", "2023-01-01 00:00:00")])
    assert sorted((str(r[1]), r[2]) for r in rows(I.valid_at(facts, asked, ["key"], "at"))) == [
        ("2024-01-01 00:00:00", 1), ("2024-01-02 00:00:00", 2)]


def test_latest_and_top(spark):
    rows = _rows(4, 600)
    df = _frame(spark, rows, ["key", "at", "id"])
    got = {r["key"]: r["id"] for r in L.latest_by_key(df, ["key"], ["at", "id"]).collect()}
    top = L.top_n_by_key(df, ["key"], [df["at"].desc(), df["id"].desc()], 3).collect()
    for key in got:
        mine = sorted(((r[1], r[2]) for r in rows if r[0] == key), reverse=True)
        assert got[key] == mine[0][1]
        assert {r["id"] for r in top if r["key"] == key} == {i for _, i in mine[:3]}


def test_upsert(table, rows):
    base = table("k string, v int, updated_at timestamp_ntz", [("a", 9, "2024-01-01 00:00:00"), ("b", 9, "2024-01-01 00:00:00")])
    new = table("k string, v int, updated_at timestamp_ntz", [
        ("a", 1, "2020-01-01 00:00:00"), ("a", 2, "2020-01-01 00:00:00"), ("c", 3, None)])
    out = L.upsert(base, new, ["k"], ["v"], updated_at="updated_at", as_of="2024-06-01 00:00:00")
    assert [(k, v, str(t)[:10]) for k, v, t in rows(out, "k")] == [
        ("a", 2, "2024-06-01"), ("b", 9, "2024-01-01"), ("c", 3, "2024-06-01")]


def test_filters(table, rows):
    df = table("id int, at timestamp_ntz", [
        (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-01-03 00:00:00"), (4, None)])
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    now = "2024-01-03 00:00:00"
    assert ids(L.retain(df, "at", 1, now)) == [2, 3]
    assert ids(L.changed_since(df, "at", 24, now)) == [2, 3]
    assert ids(L.changed_since(df, "at", 24, now, strict=True)) == [3]
    assert ids(L.in_time_range(df, "at", "2024-01-01", "2024-01-02")) == [1, 2]
    assert ids(L.in_time_range(df, "at")) == [1, 2, 3, 4]
    assert [r["id"] for r in L.page(df, ["id"], 2, 1).collect()] == [3, 4]


def test_filter_reaches_the_scan(spark, tmp_path, table):
    path = str(tmp_path / "t")
    table("id int, at timestamp_ntz", [(1, "2024-01-01 00:00:00")]).write.parquet(path)
    plan = L.retain(spark.read.parquet(path), "at", 30, "2024-01-05 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at" in plan


def test_missing_keys_stay(table, rows):
    df = table("key string, at timestamp_ntz, id int", [
        (None, "2024-01-01 00:00:00", 1), ("a", None, 2), ("a", "2024-01-01 00:00:00", 3), ("a", "2024-01-05 00:00:00", 4)])
    got = {r["id"]: r["valid_to"] and str(r["valid_to"]) for r in I.with_next(df, ["key"], "at").collect()}
    assert got == {1: None, 2: None, 3: "2024-01-05 00:00:00", 4: None}
    asked = table("key string, t timestamp_ntz", [(None, "2024-02-01 00:00:00"), ("a", None), ("a", "2024-02-01 00:00:00")])
    out = I.as_of_join(asked, df, ["key"], "t", "at", ["id"])
    assert sorted(str(r["id"]) for r in out.collect()) == ["4", "None", "None"]


def test_copies_collapse_before_the_windows(spark):
    """A third of the rows are copies of one row: windows must not see them one by one."""
    from pyspark.sql import functions as F
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.concat(F.lit("2024-01-"), F.format_string("%02d", F.col("id") % 28 + 1)))
        .cast("timestamp_ntz").alias("at"), F.lit(1).alias("v"))
    out = I.with_next(df, ["key"], "at")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 3000 and "Window" in plan
    below = plan[plan.index("Window"):]
    assert "Aggregate [key" in below
    hot = {r[0] and str(r[0]): r[1] for r in out.filter("key = 'hot'").groupBy("valid_to").count().collect()}
    assert hot == {None: 1, "2024-01-01 00:00:00": 999}     # one copy lasts, the others end where they start


def test_copies_leave_many_tasks(spark):
    """A moment with very many equal rows: one lasts, and the others do not leave one task."""
    from pyspark.sql import functions as F

    from featloom.operators import intervals, nesting

    df = spark.range(60_000).selectExpr("1 AS k", "timestamp_ntz'2024-01-01' AS t", "'x' AS v").unionByName(
        spark.sql("SELECT 1 AS k, timestamp_ntz'2024-01-02' AS t, 'y' AS v"))
    got = intervals.with_next(df, ["k"], "t")
    ends = {(r["t"].day, r["valid_to"] and r["valid_to"].day): r["count"] for r in got.groupBy("t", "valid_to").count().collect()}
    assert ends == {(1, 2): 1, (1, 1): 59_999, (2, None): 1}
    counted = spark.createDataFrame([("a", 100_000), ("b", 1), ("c", 0), ("d", 10_000), ("e", 10_001)], "v string, n bigint")
    out = nesting.repeated(counted, "n")
    assert dict(map(tuple, out.groupBy("v").count().collect())) == {"a": 100_000, "b": 1, "d": 10_000, "e": 10_001}
    assert out.filter("v = 'a'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
