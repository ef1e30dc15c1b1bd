"""Fixed record layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# The customer event envelope.
EVENT = T.StructType([
    T.StructField("event_id", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("app_name", T.StringType(), True),
    T.StructField("hostname", T.StringType(), True),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType()), True),
])

# Topics of the event stream.
EVENT_TOPICS = ("customer-events", "purchase-events")
DEAD_LETTER_TOPIC = "dead-letter-queue"
RAW_TOPIC, VALIDATED_TOPIC, INVALID_TOPIC = "raw-events", "validated-events", "invalid-events"

# A stream record as message brokers hand it over.
RECORD = T.StructType([
    T.StructField("key", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("partition", T.IntegerType(), True),
    T.StructField("offset", T.LongType(), True),
])

VERSIONS = "array<struct<version:int,status:string,created_at:timestamp_ntz>>"

# Time to live, in seconds.
EVENT_TTL = 86_400
DOCUMENT_TTL = 86_400
FEATURE_TTL = 7 * 86_400


def change_body(row: T.StructType) -> T.StructType:
    """A change: the row before and after, the operation and its time."""
    return T.StructType([
        T.StructField("before", row, True),
        T.StructField("after", row, True),
        T.StructField("op", T.StringType(), True),
        T.StructField("ts_ms", T.LongType(), True),
    ])


def prediction_record(features: T.StructType) -> T.StructType:
    """A message of a prediction topic."""
    return T.StructType([
        T.StructField("request_id", T.StringType(), True),
        T.StructField("model_name", T.StringType(), True),
        T.StructField("model_version", T.StringType(), True),
        T.StructField("timestamp", T.StringType(), True),
        T.StructField("features", features, True),
        T.StructField("prediction", T.DoubleType(), True),
        T.StructField("latency_ms", T.DoubleType(), True),
        T.StructField("error", T.StringType(), True),
    ])
