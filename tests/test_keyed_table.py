"""The keyed table against a dictionary, and which files its reads and writes touch."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from featloom.plans import feature_store as S
from featloom.session import scratch_dir
from featloom.sinks.keyed import KeyedTable

SCHEMA = "kind string, id string, n bigint, value double, at bigint"


@pytest.fixture
def made(spark):
    def make(rows, **options):
        df = spark.createDataFrame(rows, SCHEMA)
        options = {"keys": ["kind", "id"], "buckets": 4, "order": ["at"], "leading": "kind"} | options
        return KeyedTable.create(spark, scratch_dir(spark, "keyed"), df.schema, **options)
    return make


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_writes_against_a_dictionary(spark, made):
    """Writes in no order of time, taken-away keys, null keys, ties, compaction: the greatest order wins, then the last."""
    r = random.Random(5)
    table, want = made([]), {}
    for number in range(1, 7):
        rows = [(r.choice(["a", "b", None]), r.choice([None, *map(str, range(12))]), r.randint(0, 3), r.random(), r.randint(0, 4)) for _ in range(40)]
        gone = [(r.choice(["a", "b"]), str(r.randint(0, 11)), r.randint(0, 4)) for _ in range(5)]
        best = {}
        for row in rows:
            best.setdefault(row[:2], []).append((row[4], 0, row))
        for kind, id_, at in gone:
            best.setdefault((kind, id_), []).append((at, 1, None))
        table.write(frame(spark, rows), spark.createDataFrame(gone, "kind string, id string, at bigint"))
        scanned = {x[:2]: x for x in map(tuple, table.scan().collect())}
        for key, found in best.items():
            top = max(f[:2] for f in found)
            if key not in want or want[key][0] <= top[0]:
                options = [f[2] for f in found if f[:2] == top]
                got = scanned.get(key)
                assert got in options, (key, got, options)
                want[key] = (top[0], got)
        assert scanned == {k: row for k, (_, row) in want.items() if row is not None}
        if number == 4:
            before = len(table.version().folders)
            table.compact()
            assert len(table.version().folders) < before
            assert {x[:2]: x for x in map(tuple, table.scan().collect())} == scanned
            want = {k: x for k, x in want.items() if x[1] is not None}  # taken-away keys are forgotten
    for kind in ("a", "b"):
        assert {x[:2] for x in map(tuple, table.scan(kind).collect())} == {k for k in scanned if k[0] == kind}
        assert {x[:2] for x in map(tuple, table.scan(kind, "1").collect())} == {k for k in scanned if k[0] == kind and (k[1] or "").startswith("1")}
    asked = [("a", "1"), ("a", None), (None, "3"), (None, None), ("c", "1"), ("b", "99"), ("a", "1")]
    found = table.lookup(spark.createDataFrame(asked, "kind string, id string"))
    assert {x[:2]: x for x in map(tuple, found.collect())} == {k: scanned[k] for k in set(asked) if k in scanned}


def test_without_order_the_last_write_wins(spark, made):
    table = made([], order=(), leading=None)
    table.write(frame(spark, [("a", "1", 1, 1.0, 9)]))
    table.write(frame(spark, [("a", "1", 2, 2.0, 0), ("b", None, 1, 1.0, 1)]))
    assert sorted(map(tuple, table.scan().collect()), key=repr) == [("a", "1", 2, 2.0, 0), ("b", None, 1, 1.0, 1)]
    assert [tuple(x) for x in table.scan(version=1).collect()] == [("a", "1", 1, 1.0, 9)]


def test_reads_touch_few_files(spark, made):
    table = made([], buckets=8)
    rows = [(k, f"{i:05}", i, 1.0, 1) for i in range(400) for k in ("a", "b")]
    table.write(frame(spark, rows))
    base = set(table.scan().inputFiles())
    assert len(base) == 16
    # a scan of one leading value, and of one beginning that no later write holds
    assert len(table.scan("a").inputFiles()) == 8
    table.write(frame(spark, [("a", "00007", 0, 2.0, 2), ("b", "00391", 0, 2.0, 2)]))
    assert len(table.scan().inputFiles()) == 18, "a write adds a file to each bucket it touches and rewrites none"
    assert base < set(table.scan().inputFiles())
    low, high = set(table.scan("b", "0000").inputFiles()), set(table.scan("b", "0039").inputFiles())
    assert low < base and len(low) <= 8 and len(high - base) == 1 and len(high) <= 9
    assert table.scan("b", "0000").count() == 10 and table.scan("b", "0039").count() == 10
    # a lookup of one key
    one = table.lookup(spark.createDataFrame([("a", "00007")], "kind string, id string"))
    assert len(one.inputFiles()) == 2 and [tuple(x) for x in one.collect()] == [("a", "00007", 0, 2.0, 2)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "00007" in plan.split("PushedFilters", 1)[1]
    other = table.lookup(spark.createDataFrame([("a", "00008")], "kind string, id string"))
    assert len(other.inputFiles()) <= 2 and other.count() == 1
    assert table.lookup(spark.createDataFrame([("a", "99999")], "kind string, id string")).inputFiles() == []
    # compaction rewrites the two buckets with two files
    table.compact()
    after = set(table.scan().inputFiles())
    assert len(after) == 16 and len(after & base) == 14
    assert table.forget() == 1, "the second write's data is not named any more"
    assert table.scan().count() == 800 and table.versions() == [3]


def test_files_have_bloom_filters(spark, made):
    import pyarrow.parquet as pq
    table = made([], buckets=1)
    table.write(frame(spark, [("a", f"{i}", i, 1.0, 1) for i in range(500)]))
    file = table.scan().inputFiles()[0].removeprefix("file://")
    ids = [x["id"] for x in pq.read_table(file, columns=["id"]).to_pylist()]
    assert ids == sorted(ids)
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
            spark._jvm.org.apache.hadoop.fs.Path(file), spark.sparkContext._jsc.hadoopConfiguration()))
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    has = {columns.get(i).getPath().toDotString() for i in range(columns.size()) if columns.get(i).getBloomFilterOffset() >= 0}
    reader.close()
    assert {"kind", "id"} <= has | {"kind"} and "id" in has


def test_batches_are_written_once(spark, made):
    table = made([])
    rows = frame(spark, [("a", "1", 1, 1.0, 1)])
    assert table.write(rows, job="j", batch=0) == 1
    assert table.write(rows, job="j", batch=0) == 1 and table.write(rows, job="j", batch=1) == 2 and table.write(rows, job="k", batch=0) == 3
    assert table.write(rows, job="j", batch=1) == 3 and table.scan().count() == 1


def test_second_writer_fails(spark, made):
    table = made([])
    stale = table.version()
    table.write(frame(spark, [("a", "1", 1, 1.0, 1)]))
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(stale.__class__(**stale.__dict__ | {"number": 1}))
    assert table.scan().count() == 1


def test_empty_and_wrong(spark, made):
    table = made([])
    assert table.scan().count() == 0 and table.compact() == 0
    assert table.write(frame(spark, [])) == 1 and table.scan("a").count() == 0
    assert table.lookup(spark.createDataFrame([("a", "1")], "kind string, id string")).count() == 0
    for options in ({"keys": ["kind"]}, {"keys": ["id"]}, {"order": ["absent"]}, {"leading": "value"}):
        with pytest.raises(ValueError):
            made([], **options)
    with pytest.raises(ValueError, match="no version"):
        KeyedTable(spark, scratch_dir(spark, "none")).scan()


def test_expired_rows_leave_by_compaction(spark):
    table = S.online_table(spark, scratch_dir(spark, "online"), 2)
    rows = [("customer", str(i), "f", str(i), "2024-01-01 00:00:00", None if i % 2 else "2024-01-02 00:00:00") for i in range(20)]
    df = spark.createDataFrame(rows, "entity_type string, entity_id string, feature_name string, value string, written_at string, expires_at string")
    table.write(df)
    table.compact(keep=F.expr("expires_at IS NULL OR expires_at > TIMESTAMP_NTZ '2024-01-03'"))
    assert sorted(int(x["entity_id"]) for x in table.scan("customer").collect()) == list(range(1, 20, 2))
    got = S.read_online_table(spark.createDataFrame([("1",), ("2",)], "entity_id string"), table, ["f"], "customer", "2024-01-03")
    assert sorted(map(tuple, got.collect())) == [("1", "1", []), ("2", None, ["f"])]


def test_greatest_values(spark):
    """A column that is told to be greatest has the greatest value of all rows of a key, of one write or of several."""
    table = KeyedTable.create(spark, scratch_dir(spark, "greatest"), spark.createDataFrame([], "k int, at int, v string, seen int").schema,
                              ["k"], 2, ["at"], greatest=["seen"])
    table.write(spark.createDataFrame([(1, 5, "late", 1), (1, 2, "early", 8), (2, 1, "x", None), (None, 1, "n", 4)], "k int, at int, v string, seen int"))
    want = {1: (5, "late", 8), 2: (1, "x", None), None: (1, "n", 4)}
    read = lambda: {r["k"]: tuple(r)[1:] for r in table.scan().collect()}
    assert read() == want
    table.write(spark.createDataFrame([(1, 3, "older", 9), (2, 2, "y", 3), (None, 0, "m", None)], "k int, at int, v string, seen int"))
    want = {1: (5, "late", 9), 2: (2, "y", 3), None: (1, "n", 4)}
    assert read() == want
    table.compact()
    assert read() == want
    with pytest.raises(ValueError):
        KeyedTable.create(spark, scratch_dir(spark, "greatest"), table.scan().schema, ["k"], 2, greatest=["k"])


def test_a_log_without_greatest_columns_is_read(spark):
    table = KeyedTable.create(spark, scratch_dir(spark, "old"), spark.createDataFrame([], "k int, v string").schema, ["k"], 2)
    table.write(spark.createDataFrame([(1, "a")], "k int, v string"))
    entry = table._entry(table.version().number).removeprefix("file:")
    with open(entry) as f:
        told = json.load(f)
    del told["greatest"]
    os.remove(entry)
    crc = f"{os.path.dirname(entry)}/.{os.path.basename(entry)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    with open(entry, "w") as f:
        json.dump(told, f)
    assert table.version().greatest == () and [tuple(r) for r in table.scan().collect()] == [(1, "a")]
