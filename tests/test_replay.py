"""Streams of many micro-batches: replayed tables, watermarks, keyed states, the committing sink."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

from featloom.catalog import streams as C
from featloom.plans import events as E
from featloom.session import scratch_dir
from featloom.sinks import committed, tables as out
from featloom.sinks.keyed import KeyedTable
from featloom.sources import replay
from featloom.streaming import changes as change_stream

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def test_slices_come_in_order_at_the_given_rate(spark):
    path = scratch_dir(spark, "slices")
    df = spark.range(100).withColumn("text", F.concat(F.lit("t"), "id"))
    assert replay.prepare(df, 9 - F.col("id") % 10, path) == 10
    seen = []
    q = out.start(replay.stream(spark, path, 3), lambda b, i: seen.append(sorted({r["replay_slice"] for r in b.collect()})),
                  scratch_dir(spark, "ck"), "append", available_now=True)
    q.awaitTermination()
    assert seen == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]


def test_rows_without_a_slice_come_first(spark):
    path = scratch_dir(spark, "slices")
    assert replay.prepare(spark.createDataFrame([(1, None), (2, 5), (3, 0)], "id int, s int"), F.col("s"), path) == 3
    seen = []
    out.start(replay.stream(spark, path), lambda b, i: seen.extend(r["id"] for r in b.collect()), scratch_dir(spark, "ck"),
              "append", available_now=True).awaitTermination()
    assert seen == [1, 3, 2]


def test_a_large_slice_is_written_by_several_tasks(spark):
    """A batch takes the whole of it, and nothing of the next slice."""
    path, seen, size = scratch_dir(spark, "slices"), [], "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")
    try:
        slices = replay.prepare(spark.range(0, 200_000, 1, 8), F.when(F.col("id") % 100 == 0, 2).when(F.col("id") < 7, 0).otherwise(1), path)
    finally:
        spark.conf.unset(size)
    files = spark.read.parquet(path).where("replay_slice = 1").select(F.input_file_name()).distinct().count()
    assert slices == 3 and files > 1
    out.start(replay.stream(spark, path), lambda b, i: seen.append([tuple(r) for r in b.groupBy("replay_slice").count().collect()]),
              scratch_dir(spark, "ck"), "append", available_now=True).awaitTermination()
    assert seen == [[(0, 6)], [(1, 197_994)], [(2, 2000)]]


def test_a_stopped_stream_goes_on_behind_its_last_slice(spark):
    path, checkpoint, table = scratch_dir(spark, "slices"), scratch_dir(spark, "ck"), None
    replay.prepare(spark.range(60).selectExpr("id", "id % 7 AS k"), F.col("id") / 10, path)
    counts = replay.stream(spark, path).groupBy("k").count()
    table = KeyedTable.create(spark, scratch_dir(spark, "t"), counts.schema, ["k"], 2)

    class Stop(Exception):
        pass

    def broken(batch, i):
        table.write(batch, job="j", batch=i)
        if i == 2:
            raise Stop("after the write, before the checkpoint")

    q = out.start(counts, broken, checkpoint, available_now=True)
    with pytest.raises(Exception, match="after the write"):
        q.awaitTermination()
    version = table.version().number
    out.keyed_stream(counts, table, "j", checkpoint, compact_every=2, available_now=True).awaitTermination()
    assert table.version().number > version
    assert sorted(map(tuple, table.scan().collect())) == [(k, len(range(k, 60, 7))) for k in range(7)]


def test_late_rows_leave_the_windows_only(spark):
    """Some late events are dropped, and not all of them: the registered query's rule is met on both sides."""
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    from featloom.catalog.base import ORACLES
    kept = con.sql(f"SELECT SUM(event_count) FROM ({ORACLES['replay_over_time']})").fetchall()[0][0]
    every = con.sql(f"SELECT SUM(event_count) FROM ({ORACLES['replay_counts']})").fetchall()[0][0]
    late = con.sql(f"SELECT COUNT(*) FROM {C.SQL_REPLAYED} WHERE event_id % 10 = 0 OR event_id % 97 = 5").fetchall()[0][0]
    assert 0 < every - kept < late


def test_committed_sink_runs_where_the_package_is_not_installed(tmp_path):
    there = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import sys; from pyspark import cloudpickle; print(cloudpickle.load(sys.stdin.buffer).name())"
    ran = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(committed.CommittedSink), cwd=tmp_path, env=there, capture_output=True)
    assert ran.stdout.decode().strip() == committed.NAME, ran.stderr.decode()


def test_committed_sink_writes_once(spark):
    """A commit that fails after its files are written: the batch is repeated, its rows are there once."""
    path, checkpoint, slices = scratch_dir(spark, "sink"), scratch_dir(spark, "ck"), scratch_dir(spark, "slices")
    replay.prepare(spark.range(90), F.col("id") / 30, slices)
    rows = replay.stream(spark, slices).select("id")
    import os
    log = f"{path.removeprefix('file:')}/log"
    os.makedirs(path.removeprefix("file:"))
    open(log, "w").close()  # a file where the log should be: no entry can be written
    q = committed.start(rows, path, checkpoint)
    with pytest.raises(Exception):
        q.awaitTermination()
    os.remove(log)
    assert committed.read(spark, path, rows.schema).count() == 0
    committed.start(rows, path, checkpoint).awaitTermination()
    assert sorted(r["id"] for r in committed.read(spark, path, rows.schema).collect()) == list(range(90))
    assert [e["batch"] for e in committed._entries(path)] == [0, 1, 2]
    # files that no entry names are not read, and can be swept
    spark.range(5).write.parquet(f"{path}/stray")
    stray = [f for f in os.listdir(f"{path.removeprefix('file:')}/stray") if f.endswith(".parquet")][0]
    os.replace(f"{path.removeprefix('file:')}/stray/{stray}", f"{path.removeprefix('file:')}/data/stray.parquet")
    assert committed.read(spark, path, rows.schema).count() == 90
    assert committed.sweep(path) >= 1 and committed.read(spark, path, rows.schema).count() == 90


def test_a_committed_batch_stays(tmp_path):
    writer = committed.CommittedWriter(str(tmp_path))
    writer.commit([committed.Written("data/a.parquet", 1)], 0)
    writer.commit([committed.Written("data/b.parquet", 1)], 0)
    assert [e["files"] for e in committed._entries(str(tmp_path))] == [["data/a.parquet"]]
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == [f"{0:020d}.json"]


def change(id_, v, ts, op="u"):
    import json
    return json.dumps({"after": None if op == "d" else {"id": id_, "v": v}, "before": {"id": id_, "v": v} if op == "d" else None,
                       "op": op, "ts_ms": ts})


def test_keyed_state_of_changes(spark):
    """Late, repeated and broken messages over batches; deletes stay known, so older changes do not bring rows back."""
    sent = [(0, 1, change(1, "a", 10, "c"), 1), (0, 2, change(2, "b", 10, "c"), 2), (1, 3, change(1, "c", 30), 1), (2, 4, change(1, "b", 20), 1),
            (2, 1, change(1, "a", 10, "c"), 1), (3, 5, change(2, "b", 40, "d"), 2), (4, 6, change(2, "old", 15), 2), (4, 7, "oops", 3),
            (5, 8, change(4, "new", 5, "c"), 4), (5, 5, change(2, "b", 40, "d"), 2), (6, 9, None, 1)]
    rows = [(i, f'{{"id": {key}}}', value, "x.t", offset, f"1970-01-01 00:00:01") for i, offset, value, key in sent]
    df = spark.createDataFrame(rows, "slice int, key string, value string, topic string, offset bigint, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    log = scratch_dir(spark, "log")
    replay.prepare(df, F.col("slice"), log)
    base = spark.createDataFrame([(1, "base"), (9, "stays")], ROW)
    for compact in (None, 2):
        table = change_stream.state_table(spark, scratch_dir(spark, "state"), ROW, ["id"], base, 2)
        change_stream.start_state(replay.stream(spark, log), ROW, table, scratch_dir(spark, "ck"), compact_every=compact,
                                  available_now=True).awaitTermination()
        got = sorted(map(tuple, change_stream.state_rows(table, ROW).collect()))
        # the tombstone of key 1 has the record's time, a second after the epoch, and so is the latest
        assert got == [(4, "new"), (9, "stays")]
        assert change_stream.position(table).first()["seen"] == 9
        assert table.scan().count() == 4, "a row for each key, whatever the number of messages"


def test_updates_of_few_keys_write_few_rows(spark):
    """A micro-batch writes the keys that it changes, not the state."""
    log, checkpoint = scratch_dir(spark, "log"), scratch_dir(spark, "ck")
    first = [(0, f'{{"id": {i}}}', change(i, "a", 1, "c"), "x.t", i) for i in range(200)]
    second = [(1, '{"id": 7}', change(7, "b", 2), "x.t", 500)]
    df = spark.createDataFrame(first + second, "slice int, key string, value string, topic string, offset bigint")
    replay.prepare(df.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")), F.col("slice"), log)
    table = change_stream.state_table(spark, scratch_dir(spark, "state"), ROW, ["id"], None, 2)
    change_stream.start_state(replay.stream(spark, log), ROW, table, checkpoint, compact_every=None, available_now=True).awaitTermination()
    by_write = {}
    for f in table.version().folders:
        name = f.path.split("/data/")[1].split("-")[0]
        by_write[name] = by_write.get(name, 0) + f.rows
    assert sorted(by_write.values()) == [1, 200]


def test_a_file_of_a_slice_is_read_by_several_tasks(spark, monkeypatch):
    import pyarrow.parquet as pq
    monkeypatch.setattr(replay, "ROW_GROUP", 64 << 10)
    path = scratch_dir(spark, "slices")
    replay.prepare(spark.range(0, 200_000, 1, 1).withColumn("text", F.sha2(F.col("id").cast("string"), 256)), F.lit(0), path)
    file = spark.read.parquet(path).select(F.input_file_name()).first()[0].removeprefix("file://")
    assert pq.ParquetFile(file).num_row_groups > 4


def _sent(spark, rows, slices, columns="slice int, key string, value string, topic string, offset bigint"):
    df = spark.createDataFrame([(i, f'{{"id": {k}}}', v, "x.t", o) for i, k, v, o in rows], columns)
    log = scratch_dir(spark, "log")
    assert replay.prepare(df, F.col("slice"), log) == slices
    return replay.stream(spark, log)


@pytest.mark.parametrize("compact", [None, 2])
def test_the_table_is_the_only_state(spark, compact):
    """The last place seen of a key is the greatest of all batches, though an earlier message counts; the stream keeps no state beside it."""
    stream = _sent(spark, [(0, 1, change(1, "a", 5, "c"), 9), (1, 1, change(1, "b", 10), 3), (2, 1, change(1, "c", 7), 4)], 3)
    checkpoint, table = scratch_dir(spark, "ck"), change_stream.state_table(spark, scratch_dir(spark, "state"), ROW, ["id"], None, 2)
    change_stream.start_state(stream, ROW, table, checkpoint, compact_every=compact, available_now=True).awaitTermination()
    assert [tuple(r) for r in table.scan().select("id", "v", "ts_ms", "offset", "seen").collect()] == [(1, "b", 10, 3, 9)]
    assert change_stream.position(table).first()["seen"] == 9
    assert not os.path.exists(f"{checkpoint.removeprefix('file:')}/state")


def test_ties_do_not_depend_on_the_batch(spark):
    """Changes of one time without a place: whole rows decide, whichever comes first; a row that no message changed gives way."""
    base = spark.createDataFrame([(1, "zz"), (1, "z"), (2, "zz"), (3, "9"), (3, "10")], ROW)
    for first, second in (("a", "b"), ("b", "a")):
        stream = _sent(spark, [(0, 1, f'{{"id": 1, "v": "{first}"}}', None), (1, 1, f'{{"id": 1, "v": "{second}"}}', None)], 2)
        table = change_stream.state_table(spark, scratch_dir(spark, "state"), ROW, ["id"], base, 2)
        change_stream.start_state(stream, ROW, table, scratch_dir(spark, "ck"), unwrapped=True, compact_every=None,
                                  available_now=True).awaitTermination()
        assert sorted(map(tuple, change_stream.state_rows(table, ROW).collect())) == [(1, "b"), (2, "zz"), (3, "9")]


def test_another_table_is_refused(spark):
    table = KeyedTable.create(spark, scratch_dir(spark, "t"), T.StructType(ROW.fields + change_stream.STATE.fields), ["id"], 2)
    with pytest.raises(ValueError, match="state_table"):
        change_stream.start_state(spark.readStream.format("rate").load(), ROW, table, scratch_dir(spark, "ck"))


def test_cdc_messages_that_are_sent_twice(spark):
    """The log has the rows that a union of all messages and of every fifth again would have."""
    from featloom.catalog import base, changes as catalog_changes
    t = base.Tables(spark, "/root/testdata/sf0.001")
    sent = catalog_changes.messages(t.raw("orders"))
    arrival = F.pmod(F.xxhash64("offset"), F.lit(6))
    want = sent.withColumn("at", arrival).unionByName(sent.where("offset % 5 = 0").withColumn("at", arrival + 2))
    got = C.log(t)
    assert got.schema == want.schema and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
