"""Customer events: envelope, parsing, validity, dead letters and counts.

Every function works on static and on streaming frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featloom.functions.time import parse_iso
from featloom.schemas import DEAD_LETTER_TOPIC, EVENT, INVALID_TOPIC, RAW_TOPIC, VALIDATED_TOPIC

REQUIRED = ("event_id", "event_type", "event_timestamp")


def as_text(records: DataFrame) -> DataFrame:
    """Record key and value as text, with topic and record time."""
    return records.select(F.col("key").cast("string").alias("key"),
                          F.col("value").cast("string").alias("value"),
                          "topic", F.col("timestamp").alias("kafka_timestamp"))


def is_valid() -> Column:
    return F.col("event_id").isNotNull() & F.col("event_type").isNotNull() & F.col("event_timestamp").isNotNull()


def is_valid_strict() -> Column:
    """Required fields present and not empty, timestamp readable."""
    return F.coalesce((F.length("event_id") > 0) & (F.length("event_type") > 0)
                      & F.col("event_timestamp").isNotNull(), F.lit(False))


def parse(records: DataFrame, strict: bool = False, keep_value: bool = False) -> DataFrame:
    """Flat events with `is_valid`; text that is not JSON gives NULL fields, not an error.

    The fields come out of a generator, so that filters and later columns read them
    instead of parsing the JSON text once more each.
    """
    event = F.col("event")
    fields = F.struct(
        event["event_id"].alias("event_id"), event["event_type"].alias("event_type"),
        parse_iso(event["timestamp"]).alias("event_timestamp"), event["app_name"].alias("app_name"),
        event["hostname"].alias("hostname"), event["payload"].alias("payload"))
    flat = as_text(records).withColumn("event", F.from_json("value", EVENT)).select(
        F.col("key").alias("kafka_key"), "kafka_timestamp", "topic", *(["value"] if keep_value else []),
        F.inline(F.array(fields)))
    return flat.withColumn("is_valid", is_valid_strict() if strict else is_valid())


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter("is_valid")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Invalid events as (key, value, topic) records for the dead-letter topic."""
    bad = parsed.filter(~F.col("is_valid"))
    return bad.select(F.col("event_id").alias("key"), F.to_json(F.struct("*")).alias("value"),
                      F.lit(DEAD_LETTER_TOPIC).alias("topic"))


def topic_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """Each record for the raw topic and again for the validated or the invalid one.

    The output has the columns a broker sink takes: key, value, topic.
    """
    checked = parse(records, strict, keep_value=True)
    routes = F.array(F.lit(RAW_TOPIC), F.when(F.col("is_valid"), VALIDATED_TOPIC).otherwise(INVALID_TOPIC))
    return checked.select(F.col("kafka_key").alias("key"), "value", F.explode(routes).alias("topic"))


def archive(events: DataFrame) -> DataFrame:
    """Raw events as a relational table takes them: the payload map as JSON text."""
    return events.select("event_id", "event_type", "event_timestamp", "app_name", "hostname",
                         F.to_json("payload").alias("payload"))


def counts_by(events: DataFrame, column: str) -> DataFrame:
    """Running counts per value; NULL is a group of its own."""
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("event_count"))


def counts_over_time(events: DataFrame, width: str = "5 minutes",
                     watermark: str | None = "5 minutes") -> DataFrame:
    """Counts per event-time window and type; the watermark matters on streams only."""
    if watermark and events.isStreaming:
        events = events.withWatermark("event_timestamp", watermark)
    return (events.groupBy(F.window("event_timestamp", width).alias("window"), "event_type")
            .agg(F.count(F.lit(1)).alias("event_count"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "event_type", "event_count"))


def payload_text(field: str) -> Column:
    return F.col("payload").getItem(field)


def payload_number(field: str) -> Column:
    return F.col("payload").getItem(field).try_cast("double")
