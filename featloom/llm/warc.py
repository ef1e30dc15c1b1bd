"""A content-addressed archive of WARC records.

An archive is a folder of two tables. `payloads` holds the bytes of every payload once, under its SHA-256.
`headers` holds the exact header block of every record (WARC fields, and for a response the HTTP head) beside
the digest of its payload. A record is rebuilt by joining the two and putting the bytes in order; each
payload is hashed again when it is read, and one that does not match its address fails the job.

Of records with one payload that of the smallest page_id is the response, the others are revisits that name
it. Smaller payloads than `smallest` bytes are always stored as responses. Null html is an empty payload.
Rows that repeat the smallest page_id of a payload are all responses; a null page_id counts as the greatest,
and a revisit may then name a null page (no WARC-Refers-To). A null url gives an empty target. Other columns
of the pages are not archived. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featloom.llm.common import partitions, staged
from featloom.session import scratch_dir

#: Stated in every record: when the archive was made is not a property of the pages.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
HTTP_HEAD = CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"))
HEX_OF_5 = 5
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits; five of them make four characters."""
    parts = []
    for i in range(0, 40, HEX_OF_5):
        n = F.conv(F.substring(hex_digest, i + 1, HEX_OF_5), 16, 10).cast("bigint")
        parts += [F.substring(F.lit(BASE32), (F.shiftright(n, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def payload_of(html: Column) -> Column:
    return F.coalesce(html.cast("string").cast("binary"), F.lit(b""))


def _record_id(page: Column) -> Column:
    """A name-based id: the same page has the same one in every run."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                           for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def headers(pages: DataFrame, smallest: int = 0, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, digest, header, stored: a header block for every page; `stored` if its payload is kept for it."""
    payload = payload_of(F.col(html_col))
    facts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"),
                         F.length(payload).cast("bigint").alias("size"))
    first = facts.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    facts = facts.join(first, "digest")
    response = (F.col("size") < smallest) | F.col("page_id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = f"{HTTP_HEAD}{CRLF}Content-Length: "
    http_head = F.concat(F.lit(http), F.col("size").cast("string"), F.lit(CRLF * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        # a line break in a url must not end the field
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(response, F.lit("")).otherwise(F.concat(
            F.coalesce(line("WARC-Refers-To", F.when(F.col("first_id").isNotNull(), _record_id(F.col("first_id")))), F.lit("")),
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.when(response, F.length(http_head.cast("binary")) + F.col("size"))
             .otherwise(F.length(http_head.cast("binary"))).cast("string")),
        F.lit(CRLF), http_head)
    return facts.select("page_id", F.when(~response, F.col("first_id")).alias("first_id"), "digest",
                        head.cast("binary").alias("header"), response.alias("stored"))


def write(pages: DataFrame, folder: str, smallest: int = 0, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> str:
    """Write the archive of `pages` to `folder`; gives the name of a table of this session over the payloads.

    Payloads lie in buckets of their digests: read as that table they meet the headers where they lie.
    """
    headers(pages, smallest, id_col, url_col, html_col).write.parquet(f"{folder}/headers")
    payload = payload_of(F.col(html_col))
    table = f"warc_payloads_{uuid.uuid4().hex}"
    # copies go where the rows are read, and once more where equal digests meet
    (pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
     .groupBy("digest").agg(F.first("payload").alias("payload"))
     .write.bucketBy(partitions(pages.sparkSession), "digest").option("path", f"{folder}/payloads").saveAsTable(table))
    return table


def payloads(spark: SparkSession, folder: str, table: str | None = None) -> DataFrame:
    """digest, payload; every payload is checked against its address."""
    stored = spark.table(table) if table else spark.read.parquet(f"{folder}/payloads")
    return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
                             .otherwise(F.raise_error(F.concat(F.lit("payload does not match "), "digest")).cast("binary")))


def records(spark: SparkSession, folder: str, table: str | None = None) -> DataFrame:
    """page_id, digest, record: every record byte for byte; a revisit ends after its HTTP head."""
    heads = spark.read.parquet(f"{folder}/headers")
    own = heads.where("stored").join(payloads(spark, folder, table), "digest", "left")
    end = F.lit(CRLF * 2).cast("binary")
    return (own.select("page_id", "digest", F.concat("header", "payload", end).alias("record"))
            .unionByName(heads.where("NOT stored").select("page_id", "digest", F.concat("header", end).alias("record"))))


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload: what each page held, for responses and revisits alike."""
    heads = spark.read.parquet(f"{folder}/headers").select("page_id", "digest")
    return heads.join(payloads(spark, folder), "digest").select("page_id", "payload")


def _field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def _head(data: Column) -> Column:
    """Text up to the first empty line, which belongs to it."""
    text = data.cast("string")
    return F.substring(text, F.lit(1), F.instr(text, CRLF * 2) + 3)


def parsed(records: DataFrame) -> DataFrame:
    """page_id, digest, record_type, record_id, refers, payload_bytes, payload_digest: what whole records say.

    A record is cut into its fields, its HTTP head and its payload; it must be as long as its fields state and end in
    an empty line, and a response's payload must have the digest that they state. A revisit has no payload; its
    digest is the stated one, its number of bytes is null.
    """
    whole = records.withColumn("fields", _head(F.col("record")))
    size = F.octet_length("fields")
    whole = whole.withColumn("block", F.substring("record", size + 1, F.length("record") - size - 4))
    stated = F.regexp_extract(_field(F.col("fields"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    fits = (_field(F.col("fields"), "Content-Length").cast("bigint") == F.length("block")) & (
        F.substring("record", F.length("record") - 3, F.lit(4)) == F.lit(CRLF * 2).cast("binary"))
    kind = F.when(fits, _field(F.col("fields"), "WARC-Type")).otherwise(
        F.raise_error(F.lit("a record is not as long as it states")).cast("string"))
    http = F.octet_length(_head(F.col("block")))
    payload = F.substring("block", http + 1, F.length("block") - http)
    is_response = F.col("record_type") == "response"
    told = whole.select("page_id", "digest", kind.alias("record_type"), _field(F.col("fields"), "WARC-Record-ID").alias("record_id"),
                        _field(F.col("fields"), "WARC-Refers-To").alias("refers"), stated.alias("stated"), payload.alias("payload"))
    told = told.select("*", F.when(is_response, base32(F.sha1("payload"))).alias("found"),
                       F.when(is_response, F.length("payload").cast("bigint")).alias("payload_bytes"))
    checked = F.when(F.col("found").isNull() | (F.col("found") == F.col("stated")), F.col("stated")).otherwise(
        F.raise_error(F.lit("a header states another digest")).cast("string"))
    return told.select("page_id", "digest", "record_type", "record_id", "refers", "payload_bytes", checked.alias("payload_digest"))


def read_back(spark: SparkSession, folder: str, table: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the rebuilt records tell.

    Every record is rebuilt and taken apart once; what it says is small, and written. A revisit has its bytes and
    its page from the response that it refers to, or, if that has no id, from the one of its payload.
    """
    told = staged(parsed(records(spark, folder, table)), "records")
    # at most one response row of a payload has the name that its revisits give
    facts = (told.where("record_type = 'response'").groupBy("digest")
             .agg(F.min(F.struct("page_id", "record_id")).alias("response"), F.first("payload_bytes").alias("bytes")))
    found = F.when(F.col("refers") == F.col("response.record_id"), F.col("response.page_id"))
    return told.join(facts, "digest").select(
        "page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type",
        found.alias("refers_to"))


def archive(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write the pages to a new archive in the shared folder, rebuild all records and read them back."""
    folder, spark = scratch_dir(pages.sparkSession, "warc"), pages.sparkSession
    table = write(pages, folder, smallest)
    try:
        return read_back(spark, folder, table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay, the session forgets them


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h),
t AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST(('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1), '' ORDER BY i) AS b32
      FROM f, range(32) r(i) GROUP BY h)
SELECT page_id, n AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (h) JOIN t USING (h)
"""
