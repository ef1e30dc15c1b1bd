"""The event and change jobs run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.catalog import changes as catalog_changes, events as catalog_events
from featloom.catalog.base import Tables, query
from featloom.plans import events as E
from featloom.session import scratch_dir
from featloom.sinks import committed, tables as out
from featloom.sinks.keyed import KeyedTable
from featloom.sources import replay
from featloom.streaming import changes as change_stream, events as event_stream


def stream_of(t: Tables, name: str) -> DataFrame:
    """A given table read as a stream of its files."""
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(t.path(f"[{name[0]}]{name[1:]}"))


def _records(t: Tables) -> DataFrame:
    return catalog_events.messages(stream_of(t, "events"))


def _counts(t: Tables, name: str) -> DataFrame:
    base = scratch_dir(t.spark, name)
    parsed = E.valid(E.parse(_records(t)))
    frame = {"by_type": lambda: E.counts_by(parsed, "event_type"), "by_app": lambda: E.counts_by(parsed, "app_name"),
             "over_time": lambda: E.counts_over_time(parsed)}[name]()
    q = out.upsert_stream(frame, f"{base}/table", f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return out.current(t.spark, f"{base}/table", event_stream.KEYS[name])


@query(catalog_events.SQL_BY_TYPE)
def stream_events_by_type(t: Tables) -> DataFrame:
    return _counts(t, "by_type")


@query(catalog_events.SQL_BY_APP)
def stream_events_by_app(t: Tables) -> DataFrame:
    return _counts(t, "by_app")


@query(catalog_events.SQL_OVER_TIME)
def stream_events_over_time(t: Tables) -> DataFrame:
    return catalog_events.without_zone(_counts(t, "over_time"), "window_start", "window_end")


def _routed(t: Tables, output: str) -> str:
    base = scratch_dir(t.spark, "routed")
    q = event_stream.start_routed(E.parse(_records(t)), f"{base}/out", f"{base}/checkpoint",
                                  as_of="2024-01-31 00:00:00", available_now=True)
    q.awaitTermination()
    return f"{base}/out/{output}"


@query(catalog_events.SQL_ARCHIVE)
def stream_archive(t: Tables) -> DataFrame:
    return catalog_events.read_archive(out.appended(t.spark, _routed(t, "archive")))


@query(catalog_events.SQL_DEAD)
def stream_dead_letter(t: Tables) -> DataFrame:
    return catalog_events.read_dead_letters(out.appended(t.spark, _routed(t, "dead_letter")))


@query(f"""SELECT 'event:' || event_id AS doc_key, TIMESTAMP '2024-02-01' AS expires_at,
any_value(event_type) AS event_type, any_value(app_name) AS app_name, any_value(payload_user) AS payload_user
FROM {catalog_events.SQL_PARSED} WHERE is_valid AND event_id <> '' GROUP BY 1
UNION ALL SELECT * FROM (SELECT 'event:' AS doc_key, TIMESTAMP '2024-02-01' AS expires_at, event_type, app_name, payload_user
FROM {catalog_events.SQL_PARSED} WHERE is_valid AND event_id = '' ORDER BY event_timestamp DESC LIMIT 1)""")
def stream_documents(t: Tables) -> DataFrame:
    rows = t.spark.read.parquet(_routed(t, "documents"))
    body = F.from_json("doc", "event_type string, event_timestamp timestamp, app_name string, "
                              "payload map<string,string>")
    flat = rows.select("doc_key", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "batch_id",
                       body.alias("d")).select("doc_key", "expires_at", "batch_id", "d.*")
    newest = out.latest_by_key(flat, ["doc_key"], ["batch_id", "event_timestamp"])
    return newest.select("doc_key", "expires_at", "event_type", "app_name",
                         F.col("payload")["user_id"].alias("payload_user"))


@query(catalog_changes.SQL_APPLIED)
def stream_cdc_apply(t: Tables) -> DataFrame:
    base = scratch_dir(t.spark, "changes")
    messages = catalog_changes.messages(stream_of(t, "orders"))
    q = change_stream.start_apply(messages, catalog_changes.ROW, ["order_id"], f"{base}/table",
                                  f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return change_stream.table(t.spark, f"{base}/table", catalog_changes.base_table(t), ["order_id"])


# replayed streams ------------------------------------------------------------
SLICES = 8
#: Seconds that an event's time may fall behind the latest one seen.
DELAY = 300


def _replayed(t: Tables, base: str) -> DataFrame:
    """The events as records that arrive in the order of their ids, in slices; their times run on with the ids,
    but every tenth event tells one up to ten hours back."""
    last = t.events().agg(F.max("event_id")).first()[0] or 0
    late = t.events().withColumn("ts", F.expr(
        "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, event_id - if(event_id % 10 = 0, event_id % 36000, 0))"))
    place = F.col("key").cast("bigint") * SLICES
    replay.prepare(catalog_events.messages(late), F.floor(place / (last + 1)), f"{base}/slices")
    return replay.stream(t.spark, f"{base}/slices")


SQL_REPLAYED = f"""(SELECT event_id, event_type, slice, CASE WHEN b = 5 THEN moment - INTERVAL 2 HOUR ELSE moment END AS event_timestamp
  FROM (SELECT event_id, event_type, event_id % 97 AS b, event_id * {SLICES} // (SELECT MAX(event_id) + 1 FROM events) AS slice,
    TIMESTAMP '2024-01-01' + to_seconds(event_id - CASE WHEN event_id % 10 = 0 THEN event_id % 36000 ELSE 0 END) AS moment FROM events)
  WHERE b NOT IN (0, 1, 2, 3))"""


def _counted(t: Tables, name: str, base: str, frame: DataFrame) -> DataFrame:
    """Counts of a stream of many micro-batches, laid over a keyed table batch by batch."""
    table = KeyedTable.create(t.spark, f"{base}/table", frame.schema, event_stream.KEYS[name], buckets=4)
    out.keyed_stream(frame, table, name, f"{base}/checkpoint", compact_every=4, available_now=True).awaitTermination()
    return table.scan()


@query(f"SELECT event_type, COUNT(*) AS event_count FROM {SQL_REPLAYED} GROUP BY 1")
def replay_counts(t: Tables) -> DataFrame:
    """Running counts per type over many micro-batches: late events count."""
    base = scratch_dir(t.spark, "replay")
    return _counted(t, "by_type", base, E.counts_by(E.valid(E.parse(_replayed(t, base))), "event_type"))


@query(f"""WITH r AS {SQL_REPLAYED}, s AS (SELECT slice, MAX(event_timestamp) AS latest FROM r GROUP BY 1),
w AS (SELECT a.slice, MAX(b.latest) - INTERVAL {DELAY} SECOND AS watermark FROM s a LEFT JOIN s b ON b.slice < a.slice - 1 GROUP BY 1)
SELECT time_bucket(INTERVAL 5 MINUTE, event_timestamp) AS window_start,
 time_bucket(INTERVAL 5 MINUTE, event_timestamp) + INTERVAL 5 MINUTE AS window_end, event_type, COUNT(*) AS event_count
FROM r JOIN w ON r.slice = w.slice
WHERE watermark IS NULL OR time_bucket(INTERVAL 5 MINUTE, event_timestamp) + INTERVAL 5 MINUTE > watermark GROUP BY 1, 2, 3""")
def replay_over_time(t: Tables) -> DataFrame:
    """Windowed counts over many micro-batches: events of windows that the watermark has closed are dropped."""
    base = scratch_dir(t.spark, "replay")
    counts = E.counts_over_time(E.valid(E.parse(_replayed(t, base))), watermark=f"{DELAY} seconds")
    return catalog_events.without_zone(_counted(t, "over_time", base, counts), "window_start", "window_end")


@query(f"SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, event_timestamp FROM {SQL_REPLAYED}".replace(
    "CAST(event_id AS VARCHAR)", "CASE WHEN event_id % 97 = 4 THEN '' ELSE CAST(event_id AS VARCHAR) END"))
def replay_archive(t: Tables) -> DataFrame:
    """The archive of the same stream through the committing sink, one entry of its log for each micro-batch."""
    base = scratch_dir(t.spark, "replay")
    rows = E.valid(E.parse(_replayed(t, base))).select("event_id", "event_type", "event_timestamp")
    committed.start(rows, f"{base}/archive", f"{base}/checkpoint").awaitTermination()
    return catalog_events.without_zone(committed.read(t.spark, f"{base}/archive", rows.schema), "event_timestamp")


def log(t: Tables) -> DataFrame:
    """The change messages with the slice `at` that each arrives in; each is made once, however often it is sent."""
    arrival = F.pmod(F.xxhash64("offset"), F.lit(6))
    times = F.when(F.col("offset") % 5 == 0, F.array(arrival, arrival + 2)).otherwise(F.array(arrival))
    return catalog_changes.messages(t.raw("orders")).withColumn("at", F.explode(times))


@query(catalog_changes.SQL_APPLIED)
def cdc_state(t: Tables) -> DataFrame:
    """Changes over several micro-batches, in no order and every fifth of them twice, kept as a keyed state."""
    base = scratch_dir(t.spark, "state")
    replay.prepare(log(t), F.col("at"), f"{base}/log")
    table = change_stream.state_table(t.spark, f"{base}/table", catalog_changes.ROW, ["order_id"], catalog_changes.base_table(t))
    messages = replay.stream(t.spark, f"{base}/log")
    change_stream.start_state(messages, catalog_changes.ROW, table, f"{base}/checkpoint", compact_every=4,
                              available_now=True).awaitTermination()
    return change_stream.state_rows(table, catalog_changes.ROW)
