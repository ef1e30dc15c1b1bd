import base64
import hashlib

import pytest

from featloom.llm import warc

PAGES = "page_id bigint, url string, html string"


@pytest.fixture
def pages(spark):
    rows = [(5, "http://a/5", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (1, None, None), (2, "u\r\nX: y", ""),
            (4, "http://é/", "é€🙂\r\n\r\nWARC-Type: revisit\r\n" * 50), (6, "u", "x" * 200_000), (7, "u", "only"), (7, "u", "only"), (None, "n", "<p>same</p>"),
            (None, "n", "alone")]
    return rows, spark.createDataFrame(rows, PAGES).repartition(3).selectExpr("*", "'d' AS digest", "1 AS first_id", "'h' AS header")


def sha1(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_read_back(pages):
    rows, df = pages
    got = warc.archive(df).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((i is None, i or 0, len((h or "").encode()), sha1(h), "response" if first.get(h or "") == i else "revisit",
                   None if first.get(h or "") == i else first[h or ""]) for i, _, h in rows)
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == want


def test_records_are_whole(pages, tmp_path, spark):
    rows, df = pages
    folder = str(tmp_path / "a")
    warc.write(df, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in rows})
    text = {i: (h or "").encode() for i, _, h in rows}
    for r in warc.records(spark, folder).collect():
        record = bytes(r["record"])
        head, rest = record.split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert int(fields[b"Content-Length"]) == len(rest) - 4
        if fields[b"WARC-Type"] == b"response" and r["page_id"] is not None:
            assert rest[:-4].split(b"\r\n\r\n", 1)[1] == text[r["page_id"]]
        assert b"X" not in fields                              # a line break in a url starts no field
    back = {r["page_id"]: bytes(r["payload"]) for r in warc.pages_of(spark, folder).where("page_id IS NOT NULL").collect()}
    assert back == {i: t for i, t in text.items() if i is not None}


def test_damaged_payload_fails(pages, tmp_path, spark):
    from pyspark.sql import functions as F
    folder = str(tmp_path / "a")
    warc.write(pages[1], folder)
    broken = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    broken.write.parquet(f"{tmp_path}/b/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.payloads(spark, f"{tmp_path}/b").collect()


def test_records_that_do_not_fit_fail(pages, tmp_path, spark):
    """A record of another length, or with another payload than it states."""
    from pyspark.sql import functions as F
    folder = str(tmp_path / "a")
    warc.write(pages[1], folder)
    whole = warc.records(spark, folder)
    assert warc.parsed(whole).count() == len(pages[0])
    for change, message in ((F.concat("record", F.lit(b"\r\n\r\n")), "as long as"), (F.expr("substring(record, 1, length(record) - 1)"), "as long as"),
                            (F.expr("cast(replace(cast(record as string), 'same', 'none') as binary)"), "another digest")):
        with pytest.raises(Exception, match=message):
            warc.parsed(whole.withColumn("record", change)).collect()


def test_payloads_meet_headers_where_they_lie(pages, tmp_path, spark):
    """The join that rebuilds records moves header blocks only."""
    folder = str(tmp_path / "a")
    table = warc.write(pages[1], folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = warc.records(spark, folder, table)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {table}")


def test_small_payloads_are_not_shared(pages):
    got = {r["record_type"] for r in warc.archive(pages[1], smallest=12).where("payload_bytes < 12").collect()}
    assert got == {"response"}


def test_empty_table(pages):
    assert warc.archive(pages[1].limit(0)).count() == 0
