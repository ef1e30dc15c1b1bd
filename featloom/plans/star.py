"""Star schema: typed feature values with validity, dimension and fact loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.functions.time import Instant, instant
from featloom.functions.values import decoded_text
from featloom.operators.intervals import SLICE_SECONDS, with_next
from featloom.operators.keys import dense_keys, extend_dimension, lookup, unknown
from featloom.operators.latest import latest_by_key
from featloom.session import written

# Retention of the fact tables, in days.
FEATURE_VALUE_DAYS = 90
PREDICTION_DAYS = 30


def load_dimension(members: DataFrame, natural_key: str, key: str, as_of: Instant = None,
                   existing: DataFrame | None = None) -> DataFrame:
    """A dimension with surrogate keys; known members keep theirs when it is extended.

    A member given several times counts once, with its greatest row.
    """
    now = instant(as_of, "timestamp_ntz")
    others = [c for c in members.columns if c != natural_key]
    members = latest_by_key(members, [natural_key], others) if others else members.distinct()
    stamped = members.withColumn("created_at", now).withColumn("updated_at", now)
    if existing is None:
        return dense_keys(stamped, natural_key, key)
    return extend_dimension(existing, stamped, natural_key, key)


def typed_values(tall: DataFrame, value: str = "value", data_type: str = "data_type") -> DataFrame:
    """Text values spread over numeric, text, timestamp and boolean columns by `data_type`."""
    text = decoded_text(F.col(value))
    kind = F.upper(data_type)
    numeric = kind.isin("INT", "INTEGER", "FLOAT", "DOUBLE", "NUMERIC")
    moment = kind.isin("TIMESTAMP", "DATE")
    flag = kind.isin("BOOL", "BOOLEAN")
    return (tall.withColumn("value_numeric", F.when(numeric, text.try_cast("double")))
            .withColumn("value_text", F.when(~(numeric | moment | flag), text))
            .withColumn("value_timestamp", F.when(moment, text.try_cast("timestamp_ntz")))
            .withColumn("value_boolean", F.when(flag, text.try_cast("boolean"))))


def validity_intervals(values: DataFrame, entity: str = "entity_id", feature: str = "feature_key",
                       valid_from: str = "valid_from", slice_seconds: int = SLICE_SECONDS,
                       tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """`valid_to` is the start of the next value of the same entity and feature.

    Of values that start together the greatest `tiebreak`, then the greatest value lasts.
    """
    return with_next(values, [feature, entity], valid_from, "valid_to", tiebreak, slice_seconds)


def _sized(dimension: DataFrame, *columns: str) -> DataFrame:
    """Columns of a dimension, written so that its size is known: one of few members is broadcast, and the facts of
    a member are not brought together in one task."""
    return written(dimension.select(*columns), "dimension")


def load_feature_values(tall: DataFrame, features: DataFrame, as_of: Instant = None,
                        slice_seconds: int = SLICE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """The feature-value fact (key lookup, typed value, validity interval), and the rows of unknown features.

    `tall`: entity_id, feature_id, value, valid_from; `features`: feature_id, feature_key, data_type.
    """
    features = _sized(features, "feature_id", "feature_key", "data_type")
    keyed = tall.join(features, "feature_id")
    typed = typed_values(keyed).select(
        "feature_key", "entity_id", "value_numeric", "value_text", "value_timestamp",
        "value_boolean", "valid_from")
    facts = (validity_intervals(typed, slice_seconds=slice_seconds)
             .withColumn("created_at", instant(as_of, "timestamp_ntz")))
    return facts, unknown(tall, features, "feature_id")


def load_model_metrics(metrics: DataFrame, models: DataFrame, experiments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model-metric fact (model key required, experiment key where there is one), and the rows of unknown models."""
    models = _sized(models, "model_id", "model_key")
    with_model = lookup(metrics, models, "model_id", "model_key")
    facts = with_model.join(_sized(experiments, "experiment_id", "experiment_key"),
                            "experiment_id", "left").drop("experiment_id")
    return facts, unknown(metrics, models, "model_id")


def load_predictions(predictions: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prediction fact (model key, value, label, probability, latency in whole milliseconds), and the
    rows of unknown models."""
    models = _sized(models, "model_id", "model_key")
    keyed = lookup(predictions, models, "model_id", "model_key")
    return keyed.withColumn("latency_ms", F.round("latency_ms").cast("int")), unknown(predictions, models, "model_id")
