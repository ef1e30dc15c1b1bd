"""Event parsing, validity, dead letters and counts on static frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.catalog.base import Tables, query
from featloom.plans import events as E
from featloom.sources.streams import event_records

def messages(events: DataFrame) -> DataFrame:
    """The events table as stream records; works on a static and on a streaming frame.

    Seven of every 97 events are broken or odd, each in its own way, so that each branch is met.
    """
    odd = F.col("event_id") % 97
    eid = F.col("event_id").cast("string")
    moment = F.col("ts").cast("timestamp")
    iso = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.when(odd == 3, "garbage").when(odd == 5, "+02:00").otherwise("Z")
    stamp = F.concat(iso, zone)
    envelope = F.struct(
        F.when(odd == 4, "").when(odd != 2, eid).alias("event_id"),
        F.col("event_type"), stamp.alias("timestamp"),
        F.concat(F.when(odd != 6, "app-"), F.col("user_id") % 5).alias("app_name"),
        F.lit("host-1").alias("hostname"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string"),
                     F.lit("amount"), F.col("value").cast("string")).alias("payload"))
    value = (F.when(odd == 0, F.lit("not json")).when(odd == 1, F.lit(None).cast("string"))
             .otherwise(F.to_json(envelope)))
    topic = F.when(F.col("event_type") == "purchase", "purchase-events").otherwise("customer-events")
    return events.select(eid.alias("key"), value.alias("value"), topic.alias("topic"), moment.alias("timestamp"))


# What the parsed events must be, written from the rules above.
SQL_PARSED = """(SELECT CAST(event_id AS VARCHAR) AS kafka_key,
  CASE WHEN b <= 2 THEN NULL WHEN b = 4 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id,
  CASE WHEN b > 1 THEN event_type END AS event_type,
  CASE WHEN b IN (0, 1, 3) THEN NULL WHEN b = 5 THEN ts - INTERVAL 2 HOUR ELSE ts END AS event_timestamp,
  CASE WHEN b > 1 AND b <> 6 THEN 'app-' || (user_id % 5) END AS app_name,
  CASE WHEN b > 1 THEN 'host-1' END AS hostname,
  CASE WHEN b > 1 THEN CAST(user_id AS VARCHAR) END AS payload_user,
  CASE WHEN b > 1 THEN value END AS payload_amount,
  CASE WHEN event_type = 'purchase' THEN 'purchase-events' ELSE 'customer-events' END AS topic,
  b NOT IN (0, 1, 2, 3) AS is_valid, b NOT IN (0, 1, 2, 3, 4) AS is_strict
  FROM (SELECT *, event_id % 97 AS b FROM events))"""


def _parsed(t: Tables, strict: bool = False) -> DataFrame:
    return E.parse(messages(t.events()), strict)


@query(f"""SELECT kafka_key, topic, event_id, event_type, event_timestamp, app_name, hostname, payload_user,
payload_amount, is_valid FROM {SQL_PARSED}""")
def parse_validate(t: Tables) -> DataFrame:
    return _parsed(t).select(
        "kafka_key", "topic", "event_id", "event_type",
        F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "app_name", "hostname",
        E.payload_text("user_id").alias("payload_user"), E.payload_number("amount").alias("payload_amount"),
        "is_valid")


@query(f"SELECT kafka_key, event_id, is_strict AS is_valid FROM {SQL_PARSED}")
def parse_validate_strict(t: Tables) -> DataFrame:
    return _parsed(t, strict=True).select("kafka_key", "event_id", "is_valid")


SQL_DEAD = f"""SELECT event_id AS key, 'dead-letter-queue' AS topic, kafka_key, event_type, app_name, payload_user, is_valid
FROM {SQL_PARSED} WHERE NOT is_valid"""


def read_dead_letters(letters: DataFrame) -> DataFrame:
    body = F.from_json("value", "kafka_key string, event_type string, app_name string, "
                                "payload map<string,string>, is_valid boolean")
    return letters.select("key", "topic", body.alias("d")).select(
        "key", "topic", "d.kafka_key", "d.event_type", "d.app_name",
        F.col("d.payload")["user_id"].alias("payload_user"), "d.is_valid")


@query(SQL_DEAD)
def dead_letter(t: Tables) -> DataFrame:
    return read_dead_letters(E.dead_letters(_parsed(t)))


SQL_ARCHIVE = f"""SELECT event_id, event_type, event_timestamp, app_name, hostname, payload_user,
payload_amount FROM {SQL_PARSED} WHERE is_valid"""


def read_archive(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", "event_type", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"),
        "app_name", "hostname", F.get_json_object("payload", "$.user_id").alias("payload_user"),
        F.get_json_object("payload", "$.amount").cast("double").alias("payload_amount"))


@query(SQL_ARCHIVE)
def event_archive(t: Tables) -> DataFrame:
    return read_archive(E.archive(E.valid(_parsed(t))))


SQL_BY_TYPE = f"SELECT event_type, COUNT(*) AS event_count FROM {SQL_PARSED} WHERE is_valid GROUP BY 1"
SQL_BY_APP = f"SELECT app_name, COUNT(*) AS event_count FROM {SQL_PARSED} WHERE is_valid GROUP BY 1"
SQL_OVER_TIME = f"""SELECT time_bucket(INTERVAL 5 MINUTE, event_timestamp) AS window_start,
time_bucket(INTERVAL 5 MINUTE, event_timestamp) + INTERVAL 5 MINUTE AS window_end, event_type,
COUNT(*) AS event_count FROM {SQL_PARSED} WHERE is_valid GROUP BY 1, 2, 3"""


def without_zone(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query(f"""SELECT kafka_key AS key, CASE r WHEN 0 THEN 'raw-events' ELSE CASE WHEN is_valid THEN 'validated-events'
ELSE 'invalid-events' END END AS topic, event_id, event_type, hostname, payload_user, payload_amount FROM {SQL_PARSED}, range(2) t(r)""")
def topic_outputs(t: Tables) -> DataFrame:
    sent = E.topic_records(messages(t.events()))
    body = F.from_json("value", "event_id string, event_type string, hostname string, payload map<string,string>")
    return sent.select("key", "topic", body.alias("d")).select(
        "key", "topic", "d.event_id", "d.event_type", "d.hostname", F.col("d.payload")["user_id"].alias("payload_user"),
        F.col("d.payload")["amount"].cast("double").alias("payload_amount"))


@query(SQL_BY_TYPE)
def events_by_type(t: Tables) -> DataFrame:
    return E.counts_by(E.valid(_parsed(t)), "event_type")


@query(SQL_BY_APP)
def events_by_app(t: Tables) -> DataFrame:
    return E.counts_by(E.valid(_parsed(t)), "app_name")


@query(SQL_OVER_TIME)
def events_over_time(t: Tables) -> DataFrame:
    return without_zone(E.counts_over_time(E.valid(_parsed(t))), "window_start", "window_end")


@query("""SELECT CAST(event_id AS VARCHAR) AS key, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp",
'shop' AS app_name, 'host-1' AS hostname, CAST(user_id AS VARCHAR) AS user_id,
CASE WHEN event_type = 'purchase' THEN 'purchase-events' ELSE 'customer-events' END AS topic FROM events""")
def event_envelope(t: Tables) -> DataFrame:
    out = event_records(
        t.events(), F.col("event_type"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string")),
        "shop", "host-1", event_id=F.col("event_id").cast("string"),
        topic=F.when(F.col("event_type") == "purchase", F.lit("purchase-events")), as_of=F.col("ts"))
    body = F.from_json("value", "event_type string, timestamp string, app_name string, hostname string, "
                                "payload map<string,string>")
    return out.select("key", "topic", body.alias("d")).select(
        "key", "topic", "d.event_type", "d.timestamp", "d.app_name", "d.hostname",
        F.col("d.payload")["user_id"].alias("user_id"))
