"""Event parsing, then the same functions on streams of files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F, types as T

from featloom.plans import drift, events as E, quality as Q
from featloom.schemas import RECORD
from featloom.sinks import tables as out
from featloom.sources import streams, tables
from featloom.streaming import changes as change_stream, events as job


def event(event_id, kind="USER_LOGIN", at="2024-01-01T00:00:00Z", app="web", **payload):
    body = {"event_id": event_id, "event_type": kind, "timestamp": at, "app_name": app, "hostname": "h", "payload": payload}
    return json.dumps({k: v for k, v in body.items() if v is not None})


VALUES = [
    event("1", user_id="u1", success=True, amount=99.99, deep={"a": 1}, nothing=None),
    event("2", "PURCHASE_COMPLETED", "2024-01-01T02:00:00+02:00"),
    event("3", app=None), "not json", None, event(None), event("4", at="garbage"), event("", at="2024-01-01T00:01:00.5Z"),
    event("5", kind=None), '{"event_id": 6, "event_type": "X", "timestamp": "2024-01-01"}',
]


def records(spark, values, start=0):
    rows = [(f"k{start + i}", v, "customer-events", dt.datetime(2024, 1, 1)) for i, v in enumerate(values)]
    return spark.createDataFrame([(*r, 0, i) for i, r in enumerate(rows)], RECORD)


def test_parse(spark):
    got = {r["kafka_key"]: r for r in E.parse(records(spark, VALUES)).collect()}
    assert {k for k, r in got.items() if r["is_valid"]} == {"k0", "k1", "k2", "k7", "k9"}
    assert len(got) == len(VALUES)
    assert got["k0"]["payload"] == {"user_id": "u1", "success": "true", "amount": "99.99", "deep": '{"a":1}', "nothing": None}
    assert got["k1"]["event_timestamp"] == got["k0"]["event_timestamp"]      # the offset counts
    assert got["k3"]["event_id"] is None and got["k4"]["event_id"] is None
    strict = {r["kafka_key"] for r in E.parse(records(spark, VALUES), strict=True).filter("is_valid").collect()}
    assert strict == {"k0", "k1", "k2", "k9"}                                # the empty id goes


def test_valid_and_dead_letters_add_up(spark):
    parsed = E.parse(records(spark, VALUES))
    letters = E.dead_letters(parsed)
    assert E.valid(parsed).count() + letters.count() == len(VALUES)
    told = [json.loads(r["value"]) for r in letters.collect()]
    assert all(t["is_valid"] is False for t in told) and {"k3", "k4", "k5", "k6", "k8"} == {t["kafka_key"] for t in told}


def test_counts(spark, rows):
    good = E.valid(E.parse(records(spark, VALUES)))
    assert dict(rows(E.counts_by(good, "event_type"))) == {"USER_LOGIN": 3, "PURCHASE_COMPLETED": 1, "X": 1}
    assert dict(rows(E.counts_by(good, "app_name"))) == {"web": 3, None: 2}
    assert E.archive(good).schema["payload"].dataType == T.StringType()
    topics = dict(rows(E.topic_records(records(spark, VALUES)).groupBy("topic").count()))
    assert topics == {"raw-events": 10, "validated-events": 5, "invalid-events": 5}


def test_json_is_parsed_once(spark):
    plan = E.archive(E.valid(E.parse(records(spark, VALUES))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


# streams -----------------------------------------------------------------------
class Feed:
    """A folder of record files a stream reads; `add` puts in one more file."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.n = spark, str(tmp_path / "in"), 0

    def add(self, values):
        records(self.spark, values, self.n).coalesce(1).write.mode("append").parquet(self.path)
        self.n += len(values)

    def stream(self):
        return streams.records(self.spark, "parquet", path=self.path)


def minute(m, kind="USER_LOGIN", i=[0]):
    i[0] += 1
    return event(f"e{i[0]}", kind, (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)).isoformat() + "Z")


def run(spark, feed, tmp_path):
    queries = job.run(spark, feed.stream(), str(tmp_path / "out"), str(tmp_path / "ckpt"), as_of="2024-01-31 00:00:00",
                      wait=False, available_now=True)
    for q in queries.values():
        q.awaitTermination()
    assert all(q.exception() is None for q in queries.values())


def test_job_over_two_runs(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path)
    first = [minute(1), minute(2), minute(61), *VALUES[3:5]]
    feed.add(first)
    run(spark, feed, tmp_path)
    read = lambda name: out.current(spark, str(tmp_path / "out" / name), job.KEYS[name])
    assert dict(rows(read("by_type"))) == {"USER_LOGIN": 3}
    second = [minute(3), minute(62, "PURCHASE_COMPLETED"), minute(62)]    # the first is behind the watermark by now
    feed.add(second)
    run(spark, feed, tmp_path)
    run(spark, feed, tmp_path)                                             # nothing new: nothing changes
    assert dict(rows(read("by_type"))) == {"USER_LOGIN": 5, "PURCHASE_COMPLETED": 1}
    windows = {(r["window_start"].minute + 60 * r["window_start"].hour, r["event_type"]): r["event_count"]
               for r in read("over_time").collect()}
    assert windows == {(0, "USER_LOGIN"): 2, (60, "USER_LOGIN"): 2, (60, "PURCHASE_COMPLETED"): 1}
    archive = out.appended(spark, str(tmp_path / "out" / "archive"))
    assert archive.count() == 6 and archive.select("event_id").distinct().count() == 6    # late rows are archived
    assert out.appended(spark, str(tmp_path / "out" / "dead_letter")).count() == 2
    docs = read("documents")
    assert docs.count() == 6 and str(docs.first()["expires_at"]) == "2024-02-01 00:00:00"


def test_stream_equals_batch(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path)
    values = [minute(m % 30, "A" if m % 3 else "B") for m in range(60)]
    feed.add(values)
    run(spark, feed, tmp_path)
    batch = E.counts_over_time(E.valid(E.parse(records(spark, values))))
    streamed = out.current(spark, str(tmp_path / "out" / "over_time"), job.KEYS["over_time"])
    assert sorted(rows(streamed.select(*batch.columns))) == sorted(rows(batch))


def test_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        out.write_batch(spark.range(3), 0, path)
    out.write_batch(spark.range(2), 1, path)
    assert spark.read.parquet(path).count() == 5 and out.current(spark, path, ["id"]).count() == 3


def test_compaction_of_a_running_stream(spark, tmp_path, rows):
    """Several batches, a late row among them, compactions in between: readers see the same as without."""
    feed = Feed(spark, tmp_path)
    path, keys = str(tmp_path / "out" / "over_time"), job.KEYS["over_time"]
    with pytest.raises(ValueError):
        out.current(spark, path, keys)
    none = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    assert out.current(spark, path, keys, none).count() == 0 and out.compact_batches(spark, path, keys) is None
    read = lambda: {(r["window_start"].minute + 60 * r["window_start"].hour, r["event_type"]): r["event_count"]
                    for r in out.current(spark, path, keys).collect()}
    feed.add([minute(1), minute(2), minute(61)])
    run(spark, feed, tmp_path)
    assert out.compact_batches(spark, path, keys) is not None
    assert read() == {(0, "USER_LOGIN"): 2, (60, "USER_LOGIN"): 1}
    feed.add([minute(3), minute(62)])                       # minute 3 comes too late for its window
    run(spark, feed, tmp_path)
    assert read() == {(0, "USER_LOGIN"): 2, (60, "USER_LOGIN"): 2}
    last = out.compact_batches(spark, path, keys)
    assert out.compact_batches(spark, path, keys) == last and read() == {(0, "USER_LOGIN"): 2, (60, "USER_LOGIN"): 2}
    feed.add([minute(63, "PURCHASE_COMPLETED")])
    run(spark, feed, tmp_path)
    assert read()[(60, "PURCHASE_COMPLETED")] == 1 and read()[(60, "USER_LOGIN")] == 2
    merged = spark.read.parquet(f"{path}-compacted/upto={last}")
    assert "batch_id" in merged.columns and merged.count() == 2


def test_change_stream(spark, tmp_path, rows):
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
    message = lambda i, op, ts, s: json.dumps({"payload": {
        "before": {"id": i, "status": s} if op == "d" else None,
        "after": None if op == "d" else {"id": i, "status": s}, "op": op, "ts_ms": ts}})
    feed = Feed(spark, tmp_path)
    base = spark.createDataFrame([(1, "old"), (2, "old"), (7, "old")], row)
    go = lambda: change_stream.start_apply(feed.stream(), row, ["id"], str(tmp_path / "t"), str(tmp_path / "c"),
                                           available_now=True).awaitTermination()
    feed.add([message(1, "u", 50, "new"), message(1, "u", 10, "stale"), message(3, "c", 5, "made"), message(2, "d", 9, "old")])
    go()
    feed.add([message(1, "u", 40, "late"), message(3, "u", 6, "done")])      # 40 comes after 50 but is older
    go()
    got = rows(change_stream.table(spark, str(tmp_path / "t"), base, ["id"]), "id")
    assert got == [(1, "new"), (3, "done"), (7, "old")]


def test_dead_letter_records_to_files(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(VALUES)
    letters = E.dead_letters(E.parse(feed.stream()))
    out.records_stream(letters, "json", str(tmp_path / "c"), available_now=True, path=str(tmp_path / "o")).awaitTermination()
    assert spark.read.json(str(tmp_path / "o")).count() == 5


def test_quality_inside_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(VALUES)
    suite = Q.make_suite("s", [{"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "event_id"}}])
    check = lambda b, i: Q.save_results(Q.validate_batch(i, b, suite, "2024-01-01 00:00:00"), str(tmp_path / "r"))
    out.start(E.parse(feed.stream()), check, str(tmp_path / "c"), "append", available_now=True).awaitTermination()
    assert spark.read.json(str(tmp_path / "r")).first()["unexpected_count"] == 3


def test_drift_on_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(i % 100)) for i in range(1440)]
    log = spark.createDataFrame(rows, "at timestamp, u double")
    log.write.parquet(str(tmp_path / "log"))
    known = drift.fit_baseline(log, "u")
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")).withWatermark("at", "1 hour")
    q = out.upsert_stream(drift.hourly_psi(known, stream, "at", min_samples=500), str(tmp_path / "o"), str(tmp_path / "c"),
                          available_now=True)
    q.awaitTermination()
    streamed = {r["window_start"]: round(r["score"], 9) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    batch = {r["window_start"]: round(r["score"], 9) for r in drift.hourly_psi(known, log, "at", min_samples=500).collect()}
    assert streamed == batch and len(batch) > 10


# sources and sinks -------------------------------------------------------------
def test_published_events_parse_back(spark):
    src = spark.createDataFrame([("A", {"user_id": "u"}, "id-1"), ("B", None, None)], "t string, p map<string,string>, i string")
    published = streams.event_records(src, F.col("t"), F.col("p"), "app", "host", F.col("i"), as_of="2024-01-01 10:00:00").collect()
    back = E.parse(spark.createDataFrame([(*r, 0, i) for i, r in enumerate(published)], RECORD)).orderBy("event_type").collect()
    assert [r["is_valid"] for r in back] == [True, True]
    assert back[0]["event_id"] == "id-1" == back[0]["kafka_key"] and len(back[1]["event_id"]) == 36
    assert back[1]["payload"] == {} and str(back[0]["event_timestamp"]) == "2024-01-01 10:00:00"
    assert published[0]["topic"] == "customer-events"


def test_prediction_topic(spark):
    features = T.StructType([T.StructField("age", T.DoubleType())])
    value = json.dumps({"request_id": "r", "model_name": "m", "model_version": "1", "timestamp": "2024-01-01T00:00:00Z",
                        "features": {"age": 3}, "prediction": 0.5})
    r = streams.predictions(records(spark, [value]), features).first()
    assert (r["features"]["age"], r["prediction"], str(r["ts"]), r["error"]) == (3.0, 0.5, "2024-01-01 00:00:00", None)


def test_csv_needs_a_schema(spark, tmp_path):
    spark.createDataFrame([(1.5, "x")], "a double, b string").write.option("header", "true").csv(str(tmp_path / "c"))
    assert tables.files(spark, str(tmp_path / "c"), "csv", "a double, b string").first()["a"] == 1.5
    with pytest.raises(ValueError):
        tables.files(spark, str(tmp_path / "c"), "csv")
    with pytest.raises(ValueError):
        tables.jdbc(spark, "jdbc:x", table="t", query="q")


def test_documents_to_a_store(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import tempfile
        return open(tempfile.mkstemp(dir=folder, suffix=".log")[1], "a")

    def put(client, chunk):
        client.write(f"{len(chunk)}\n")
        client.flush()
    out.write_documents(spark.range(25).repartition(2), connect, put, batch_size=10)
    sizes = [int(x) for p in tmp_path.glob("*.log") for x in p.read_text().split()]
    assert sum(sizes) == 25 and max(sizes) <= 10


def test_counts_come_with_the_write(spark, tmp_path):
    df, seen = out.with_counts(E.parse(records(spark, VALUES)), "events", invalid="NOT is_valid")
    df.write.parquet(str(tmp_path / "x"))
    assert seen.get == {"rows": 10, "invalid": 5}
