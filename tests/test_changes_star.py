import json

import pytest
from pyspark.sql import functions as F, types as T

from featloom.operators import keys as K
from featloom.plans import changes as C, star

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
NOW = "2024-02-01 00:00:00"


def message(op, ts, before=None, after=None, topic="dbz.public.orders"):
    some = before or after
    return (json.dumps({"id": some[0]}), json.dumps({"payload": {
        "before": before and {"id": before[0], "status": before[1]},
        "after": after and {"id": after[0], "status": after[1]}, "op": op, "ts_ms": ts}}), topic)


@pytest.fixture
def messages(table):
    return table("key string, value string, topic string", [
        message("u", 30, (1, "PENDING"), (1, "COMPLETED")), message("c", 10, None, (1, "PENDING")),   # out of order
        message("c", 10, None, (2, "PENDING")), message("d", 20, (2, "PENDING")),
        message("u", 15, (3, "PENDING"), (3, "PENDING")), message("r", 1, None, (4, "PENDING")),
        ('{"id": 5}', None, "dbz.public.orders"), ("{}", "not json", "dbz.public.orders")])


def test_parse_and_classify(messages, rows):
    changes = C.parse(messages, ROW, ["id"])
    assert changes.count() == 7 and set(r["table_name"] for r in changes.collect()) == {"orders"}
    got = sorted((r["change"], (r["after"] or r["before"])["id"]) for r in C.classify_orders(changes).collect())
    assert got == [("created", 1), ("created", 2), ("deleted", 2), ("snapshot", 4), ("status_changed", 1), ("updated", 3)]
    assert [r["value"] for r in C.rejects(messages, ROW, ["id"]).collect()] == ["not json"]


def test_apply(messages, table, rows):
    base = table("id bigint, status string", [(1, "OLD"), (2, "OLD"), (5, "OLD"), (9, "OLD")])
    after = C.apply(base, C.flat(C.parse(messages, ROW, ["id"]), ROW), ["id"])
    assert rows(after, "id") == [(1, "COMPLETED"), (3, "PENDING"), (4, "PENDING"), (9, "OLD")]   # 5 by its tombstone


LOG = "key string, value string, topic string, offset bigint, timestamp timestamp"
AT = "2024-01-01 00:00:00"


def test_unwrapped_as_the_connector_sends_it(table, rows):
    key = lambda i: json.dumps({"schema": {"type": "struct"}, "payload": {"id": i}})
    row = lambda i, status: json.dumps({"schema": {}, "payload": {"id": i, "status": status}})
    sent = table(LOG, [
        (key(1), row(1, "NEW"), "x.orders", 0, AT), (key(1), row(1, "PAID"), "x.orders", 1, AT),      # one time: the offset decides
        (key(2), row(2, "NEW"), "x.orders", 2, AT), (key(2), None, "x.orders", 3, AT),
        (key(3), None, "x.orders", 5, AT), (key(3), row(3, "BACK"), "x.orders", 6, AT),               # inserted again after its delete
        ('{"id": 4}', '{"id": 4, "status": "BARE"}', "x.orders", 7, AT),
        ("{}", "oops", "x.orders", 8, AT), (None, None, "x.orders", 9, AT), (key(9), '{"status": "NO KEY"}', "x.orders", 10, AT)])
    changes = C.parse(sent, ROW, ["id"], unwrapped=True)
    base = table("id bigint, status string", [(2, "OLD"), (3, "OLD"), (8, "OLD")])
    got = C.apply(base, C.flat(changes.repartition(5), ROW), ["id"])
    assert rows(got, "id") == [(1, "PAID"), (3, "BACK"), (4, "BARE"), (8, "OLD")]
    bad = C.rejects(sent, ROW, ["id"], unwrapped=True)
    assert sorted(r["offset"] for r in bad.collect()) == [8, 9, 10] and changes.count() + bad.count() == sent.count()


def test_envelope_with_and_without_payload(table, rows):
    bare = json.dumps({"before": None, "after": {"id": 1, "status": "A"}, "op": "c", "ts_ms": 5})
    sent = table(LOG, [('{"id": 1}', bare, "t", 0, AT), ('{"id": 2}', json.dumps({"payload": json.loads(bare)}), "t", 1, AT),
                       ('{"id": 2}', '{"payload": {"op": "c"}}', "t", 2, AT)])
    assert C.parse(sent, ROW, ["id"]).count() == 2 and C.rejects(sent, ROW, ["id"]).first()["offset"] == 2


def test_apply_does_not_move_the_base(spark, table):
    base = spark.range(1000).selectExpr("id", "'OLD' AS status")
    changes = table("id bigint, status string, op string, ts_ms bigint, offset bigint", [(1, "NEW", "u", 1, 1)])
    plan = C.apply(base, changes, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    kept = plan.split("Join LeftAnti")[1].split("Window")[0]
    assert "Range (0, 1000" in kept.split("Project")[0] or plan.index("Range (0, 1000") < plan.index("Window")
    assert plan.count("Range (0, 1000") == 1


def test_dense_keys(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("nk"))
    a = {r["nk"]: r["k"] for r in K.dense_keys(df.repartition(7), "nk", "k").collect()}
    b = {r["nk"]: r["k"] for r in K.dense_keys(df.repartition(3), "nk", "k").collect()}
    assert a == b and sorted(a.values()) == list(range(1, 5001))


def test_dimension_grows_without_moving_keys(spark, tmp_path):
    first = star.load_dimension(spark.range(100).select(F.col("id").cast("string").alias("user_id")), "user_id", "user_key", NOW)
    first.write.parquet(str(tmp_path / "d"))
    old = spark.read.parquet(str(tmp_path / "d"))
    new = star.load_dimension(spark.range(50, 150).select(F.col("id").cast("string").alias("user_id")), "user_id", "user_key", NOW, old)
    got = {r["user_id"]: r["user_key"] for r in new.collect()}
    assert sorted(got.values()) == list(range(1, 151))
    assert all(got[r["user_id"]] == r["user_key"] for r in old.collect())


def test_typed_values(table, rows):
    df = table("data_type string, value string", [
        ("FLOAT", "1.5"), ("INT", '"7"'), ("float", "junk"), ("STRING", '"a b"'), ("TIMESTAMP", "2024-01-01T00:00:00"),
        ("BOOL", "true"), ("BOOL", "maybe"), ("STRING", "null")])
    got = [(r["value_numeric"], r["value_text"], r["value_timestamp"] and str(r["value_timestamp"]), r["value_boolean"])
           for r in star.typed_values(df).collect()]
    assert got == [(1.5, None, None, None), (7.0, None, None, None), (None,) * 4, (None, "a b", None, None),
                   (None, None, "2024-01-01 00:00:00", None), (None, None, None, True), (None,) * 4, (None,) * 4]


def test_facts(table, rows):
    models = table("model_key bigint, model_id string", [(1, "m:1")])
    experiments = table("experiment_key bigint, experiment_id string", [(5, "e")])
    metrics = table("model_id string, experiment_id string, metric_value double", [("m:1", "e", 1.0), ("m:1", None, 2.0), ("x", "e", 3.0)])
    facts, lost = star.load_model_metrics(metrics, models, experiments)
    got = facts.select("model_key", "experiment_key", "metric_value")
    assert [r["model_id"] for r in lost.collect()] == ["x"]
    assert sorted(rows(got), key=lambda r: r[2]) == [(1, 5, 1.0), (1, None, 2.0)]
    assert rows(K.unknown(metrics, models, "model_id").select("model_id")) == [("x",)]
    scored = table("model_id string, entity_id string, latency_ms double", [("m:1", "a", 2.5)])
    facts, lost = star.load_predictions(scored, models)
    assert facts.first()["latency_ms"] == 3 and lost.count() == 0


def test_changes_are_parsed_once(spark):
    """The messages' generator stands in what writes the reduced changes, and not again in the plan of the table."""
    from featloom.catalog import changes as catalog
    from featloom.catalog.base import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = catalog.cdc_apply(t)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "from_json" not in plan


def test_rejects_are_counted_with_what_is_valid(spark):
    """The orders are read and parsed once for each form of the messages."""
    from featloom import catalog
    plan = catalog.QUERIES["cdc_rejects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("inline(") == 2


def test_facts_of_a_model_are_not_one_task(spark):
    """A dimension that a plan computes is looked up without dealing the facts by its few keys."""
    facts = spark.range(1_000_000).selectExpr("'m' || id % 2 AS model_id", "cast(id as double) AS latency_ms")
    models = star.load_dimension(facts.select("model_id").distinct(), "model_id", "model_key", "2024-01-01 00:00:00")
    for frame in star.load_predictions(facts, models):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
