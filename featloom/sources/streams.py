"""Record streams and publishing of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from featloom.functions.time import Instant, instant, iso_utc
from featloom.schemas import EVENT_TOPICS, RECORD, prediction_record


def records(spark: SparkSession, fmt: str = "kafka", topics: Sequence[str] = EVENT_TOPICS,
            starting_offsets: str = "latest", schema: T.StructType = RECORD, **options: str) -> DataFrame:
    """A stream of (key, value, topic, timestamp) records.

    From a broker with `fmt="kafka"` (option `kafka.bootstrap.servers`), or from files of
    records in any file format (option `path`).
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return (reader.option("subscribe", ",".join(topics)).option("startingOffsets", starting_offsets)
                .option("failOnDataLoss", "false").load())
    return reader.schema(schema).load()


def event_records(events: DataFrame, event_type: Column, payload: Column, app_name: str | Column,
                  hostname: str | Column, event_id: Column | None = None, topic: Column | None = None,
                  default_topic: str = EVENT_TOPICS[0], as_of: Instant = None) -> DataFrame:
    """Events as records to publish: key is the event id, value the JSON envelope.

    A missing id becomes a random one, a missing topic the default, a missing payload an
    empty object. `as_of` may be a column with the event time.
    """
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    eid = F.uuid() if event_id is None else F.coalesce(event_id, F.uuid())
    where = F.lit(default_topic) if topic is None else F.coalesce(topic, F.lit(default_topic))
    moment = instant(as_of)
    staged = events.select(
        eid.alias("event_id"), event_type.alias("event_type"), iso_utc(moment).alias("timestamp"),
        text(app_name).alias("app_name"), text(hostname).alias("hostname"),
        F.coalesce(payload, F.create_map().cast("map<string,string>")).alias("payload"),
        where.alias("topic"), moment.alias("_at"))
    envelope = F.struct("event_id", "event_type", "timestamp", "app_name", "hostname", "payload")
    return staged.select(F.col("event_id").alias("key"),
                         F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"),
                         "topic", F.col("_at").alias("timestamp"))


def predictions(records: DataFrame, features: T.StructType) -> DataFrame:
    """Messages of a prediction topic as flat rows."""
    parsed = F.from_json(F.col("value").cast("string"), prediction_record(features))
    return (records.select(parsed.alias("p")).select("p.*")
            .withColumn("ts", F.try_to_timestamp("timestamp")).drop("timestamp"))
