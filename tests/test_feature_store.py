import json

import pytest

from featloom.functions.values import as_number, decoded_text, is_json, typed
from featloom.plans import feature_store as S, maintain, materialize as M

NOW = "2024-02-01 00:00:00"
ONLINE = ("entity_type string, entity_id string, feature_name string, value string, "
          "written_at timestamp_ntz, expires_at timestamp_ntz")


@pytest.fixture
def online(table):
    at = "2024-01-31 00:00:00"
    return table(ONLINE, [
        ("customer", "customer123", "total", "1250.75", at, None),
        ("customer", "customer123", "days", "3", at, "2024-02-02 00:00:00"),
        ("customer", "customer123", "days", "4", "2024-01-30 00:00:00", None),
        ("customer", "customer123", "gone", "7", at, NOW),                 # expires exactly now
        ("customer", "customer123", "name", "plain text", at, None),
        ("customer", "customer123", "quoted", '"12.5"', at, None),
        ("customer", "customer123", "flag", "true", at, None),
        ("customer", "customer123", "nothing", "null", at, None),
        ("customer", "customer456", "total", "753.25", at, None),
        ("product", "customer123", "total", "1.0", at, None)])


@pytest.fixture
def keys(table):
    return table("entity_id string", [("customer123",), ("customer456",), ("nobody",)])


def test_lookup(online, keys, rows):
    got = {r[0]: r[1:] for r in rows(S.read_online(keys, online, ["total", "days", "gone", "nothing"], "customer", NOW))}
    assert got["customer123"] == ("1250.75", "3", None, "null", ["gone"])   # JSON null is a value, not a miss
    assert got["customer456"] == ("753.25", None, None, None, ["days", "gone", "nothing"])
    assert got["nobody"] == (None, None, None, None, ["total", "days", "gone", "nothing"])


def test_typed_lookup(online, keys):
    types = {"total": "FLOAT", "days": "INT", "flag": "BOOL", "quoted": "STRING", "name": "FLOAT", "nothing": "INT"}
    r = S.read_typed(keys, online, types, "customer", NOW).filter("entity_id = 'customer123'").first()
    assert (r["total"], r["days"], r["flag"], r["quoted"], r["name"], r["nothing"]) == (1250.75, 3, True, "12.5", None, None)


def test_vector(online, keys):
    names = ["days", "total", "quoted", "flag", "name", "nothing"]
    r = S.feature_vectors(keys, online, names, "customer", NOW).filter("entity_id = 'customer123'").first()
    assert r["vector"] == [3.0, 1250.75, 12.5, 1.0, None, None]
    assert r["non_numeric"] == {"name": "plain text"}


@pytest.mark.parametrize("text,plain,number,json_ok", [
    ("1250.75", "1250.75", 1250.75, True), ('"abc"', "abc", None, True), ("null", None, None, True),
    ("{oops", "{oops", None, False), ("", "", None, False), ("true", "true", 1.0, True), ("21.0", "21.0", 21.0, True),
    ('{"a":1}', '{"a":1}', None, True), ('"unclosed', '"unclosed', None, False), (" 7 ", " 7 ", 7.0, True)])
def test_decoding(table, text, plain, number, json_ok):
    from pyspark.sql import functions as F
    r = table("v string", [(text,)]).select(
        decoded_text(F.col("v")).alias("p"), as_number(F.col("v")).alias("n"), is_json(F.col("v")).alias("j")).first()
    assert (r["p"], r["n"], bool(r["j"])) == (plain, number, json_ok)


def test_typed_collections(table):
    from pyspark.sql import functions as F
    df = table("v string", [("[1,2]",)])
    assert df.select(typed(F.col("v"), "ARRAY").alias("x")).first()["x"] == ["1", "2"]


def test_write_wide(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.5, "text", True, float("nan"), None), (None, 1.0, "x", False, 2.0, None), ("", 1.0, "x", False, 2.0, None)],
        "entity_id string, n double, s string, b boolean, bad double, nil int")
    got = {r[0]: r[1] for r in rows(S.to_online(df, "customer", ttl_seconds=60, as_of=NOW).select("feature_name", "value"))}
    assert got == {"n": "1.5", "s": "text", "b": "true"}
    kept = {r[0]: r[1] for r in rows(S.to_online(df.limit(1), "customer", as_of=NOW, keep_nulls=True).select("feature_name", "value"))}
    assert kept["nil"] == "null" and kept["bad"] == "null"
    first = S.to_online(df, "customer", ttl_seconds=60, as_of=NOW).first()
    assert str(first["expires_at"]) == "2024-02-01 00:01:00"


def test_last_row_of_an_id_wins_as_a_whole(spark, rows):
    df = spark.createDataFrame([("a", 1, 9, 100), ("a", 2, 10, 20), ("b", 2, 1, 1), ("b", 1, 5, 5), ("c", 1, 1, 7), ("c", 2, None, 3)],
                               "entity_id string, seq int, x int, y int")
    got = S.store_features_batch(df, "pair", NOW, order=["seq"]).select("entity_id", "feature_name", "value")
    assert sorted(rows(got)) == [("a", "x", "10"), ("a", "y", "20"), ("b", "x", "1"), ("b", "y", "1"), ("c", "y", "3")]
    # without an order the rows still do not mix
    free = {r["feature_name"]: r["value"] for r in S.store_features_batch(df.filter("entity_id = 'a'").drop("seq"), "pair", NOW).collect()}
    assert free in ({"x": "9", "y": "100"}, {"x": "10", "y": "20"})


def test_expired_latest_value_stays_gone(table, rows):
    online = table(ONLINE, [("customer", "a", "f", "10", "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
                            ("customer", "a", "f", "20", "2024-01-05 00:00:00", "2024-01-06 00:00:00")])
    asked = table("entity_id string", [("a",)])
    assert rows(S.read_online(asked, online, ["f"], "customer", "2024-01-10 00:00:00")) == [("a", None, ["f"])]
    assert rows(S.read_online(asked, online, ["f"], "customer", "2024-01-05 12:00:00")) == [("a", "20", [])]


def test_merge_keeps_the_newer_row(table, rows):
    base = table(ONLINE, [("customer", "a", "f", "1", "2024-01-05 00:00:00", None), ("customer", "b", "f", "2", "2024-01-05 00:00:00", None)])
    late = table(ONLINE, [("customer", "a", "f", "old", "2024-01-04 00:00:00", None), ("customer", "c", "f", "3", "2024-01-04 00:00:00", None)])
    assert sorted(rows(S.merge_online(base, late).select("entity_id", "value"))) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_history(spark, table, rows):
    wide = table("entity_id string, x double, y string, at timestamp_ntz", [
        ("a", 1.0, "p", "2024-01-01 00:00:00"), ("a", None, "q", "2024-01-02 00:00:00"),
        ("a", 3.0, None, "2024-01-03 00:00:00"), ("a", 4.0, "r", None), ("b", 9.0, "s", "2024-01-02 00:00:00")])
    past = S.to_history(wide, "customer", timestamp="at", as_of=NOW)
    assert json.loads(past.filter("data like '%q%'").first()["data"]) == {"x": None, "y": "q"}
    got = rows(S.read_history(past, ["y", "x", "zzz"], "customer", "a", "2024-01-02 00:00:00", "2024-02-01 00:00:00", 2))
    assert [(str(r[1])[:10], *r[2:]) for r in got] == [("2024-02-01", "r", "4.0", None), ("2024-01-03", None, "3.0", None)]
    assert S.read_history(past, ["x"], "customer").count() == past.count()
    per_entity = S.read_history(past, ["x"], "customer", limit=1)
    assert {(r[0], r[2]) for r in rows(per_entity)} == {("a", "4.0"), ("b", "9.0")}
    assert S.read_history(past, ["x"], "product").count() == 0


def test_point_in_time(table, rows):
    past = S.to_history(table("entity_id string, x int, at timestamp_ntz", [
        ("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-05 00:00:00")]), "customer", timestamp="at")
    labels = table("entity_id string, label_time timestamp_ntz", [
        ("a", "2023-12-31 00:00:00"), ("a", "2024-01-01 00:00:00"), ("a", "2024-01-04 23:00:00"), ("a", "2024-03-01 00:00:00"),
        ("z", "2024-03-01 00:00:00")])
    got = rows(S.point_in_time(labels, past, ["x"], "customer"), "entity_id", "label_time")
    assert [r[3] for r in got] == [None, "1", "1", "2", None]


def test_query(spark, table):
    table("entity_id int, entity_type string, f double", [(1, "customer", None), (2, "product", 2.0)]).createOrReplaceTempView("src")
    got = {(r["entity_type"], r["entity_id"]): r["value"] for r in S.materialize_query(spark, "SELECT * FROM src").collect()}
    assert got == {("customer", "1"): "null", ("product", "2"): "2.0"}


def test_merge_and_compact(online, table):
    new = table(ONLINE, [("customer", "customer123", "gone", "8", "2024-01-31 12:00:00", None)])
    merged = S.merge_online(online, new)
    assert merged.filter("feature_name = 'gone'").collect()[0]["value"] == "8"
    kept = maintain.compact(online, S.ONLINE_KEY, ["written_at", "value"], NOW)
    assert kept.filter("feature_name = 'gone'").count() == 0 and kept.filter("feature_name = 'days'").count() == 1


# offline and online ------------------------------------------------------------
TALL = "customer_id string, feature_name string, feature_value string, timestamp timestamp_ntz"


def test_to_online(table, rows):
    tall = table(TALL, [
        ("c1", "f", "1", "2024-01-31 10:00:00"), ("c1", "f", "2", "2024-01-31 11:00:00"), ("c1", "g", None, "2024-01-31 11:00:00"),
        ("c1", "old", "3", "2024-01-30 23:59:59"), ("c1", "edge", "4", "2024-01-31 00:00:00"),
        ("c2", "f", "5", "2024-01-31 11:00:00"), ("c2", "f", "6", "2024-01-31 11:00:00")])
    got = rows(M.to_online(tall, "customer", 24, NOW), "key")
    assert [(r[0], r[1]) for r in got] == [("customer:c1:edge", "4"), ("customer:c1:f", "2"), ("customer:c1:g", "null"),
                                           ("customer:c2:f", "6")]
    assert str(got[0][3]) == "2024-02-08 00:00:00"
    only = M.to_online(tall, "customer", 24, NOW, features=["g"])
    assert only.count() == 1


KEYED = "key string, value string, written_at timestamp_ntz, expires_at timestamp_ntz"


def test_from_online(table, rows):
    at = "2024-01-31 10:00:00"
    online = table(KEYED, [
        ("customer:c1:f", "1", at, None), ("customer:c1:x:f", "1", at, None), ("customer:f", "1", at, None),
        ("customer:c1:g", "{bad", at, None), ("customer:c1:h", "", at, None), ("customer:c1:i", None, at, None),
        ("customer_product:c1:p1:f", "2", at, None), ("product:p1:f", "3", at, None),
        ("product:p1:gone", "3", at, NOW), ("product:p1:here", "4", at, "2024-02-01 00:00:01")])
    assert [r[:3] for r in rows(M.from_online(online, "customer", as_of=NOW))] == [("c1", "f", "1")]
    assert [r[:4] for r in rows(M.from_online(online, "customer_product", as_of=NOW))] == [("c1", "p1", "f", "2")]
    assert sorted(r[:3] for r in rows(M.from_online(online, "product", as_of=NOW))) == [("p1", "f", "3"), ("p1", "here", "4")]


def test_round_trip_adds_nothing(table, rows):
    tall = table(TALL, [("c1", "f", "1", "2024-01-31 10:00:00"), ("c1", "f", "2", "2024-01-31 11:00:00"),
                        ("c2", "g", '"s"', "2024-01-31 11:00:00")])
    empty = table(KEYED, [("x", "1", None, None)]).filter("false")
    online, offline = M.run({"customer": tall}, empty, "both", ["customer"], 24, NOW)
    assert sorted(rows(offline["customer"])) == sorted(rows(tall))
    again, _ = M.run({"customer": offline["customer"]}, online, "online", ["customer"], 24, NOW)
    assert sorted(rows(again)) == sorted(rows(online))
    with pytest.raises(ValueError):
        M.run({}, empty, "sideways")
