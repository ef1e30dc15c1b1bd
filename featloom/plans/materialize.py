"""Feature values moved between the offline tables and the online store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from featloom.functions.keys import ENTITY_IDS, joined, key_has_shape, key_parts, online_key
from featloom.functions.time import Instant, instant, interval
from featloom.functions.values import is_json
from featloom.operators.latest import changed_since, latest_by_key, upsert
from featloom.plans.feature_store import live
from featloom.schemas import FEATURE_TTL


def to_online(tall: DataFrame, entity_type: str, since_hours: float = 24, as_of: Instant = None,
              features: Sequence[str] | None = None, ttl_seconds: int = FEATURE_TTL) -> DataFrame:
    """The latest value per entity and feature within `since_hours`, as keyed online rows.

    `tall` holds the id columns of the entity type, `feature_name`, `feature_value`
    (JSON text) and `timestamp`. The timestamp travels on as `written_at`.
    """
    ids = ENTITY_IDS[entity_type]
    recent = changed_since(tall, "timestamp", since_hours, as_of)
    if features is not None:
        recent = recent.filter(F.col("feature_name").isin(list(features)))
    keys = [*ids, "feature_name"]
    newest = latest_by_key(recent.select(*keys, "feature_value", "timestamp"), keys,
                           ["timestamp", "feature_value"])
    entity_id = joined(*[F.col(c) for c in ids])
    return newest.select(
        online_key(entity_type, entity_id, F.col("feature_name")).alias("key"),
        F.coalesce("feature_value", F.lit("null")).alias("value"),
        F.col("timestamp").alias("written_at"),
        (instant(as_of, "timestamp_ntz") + interval(ttl_seconds, "second")).alias("expires_at"))


def from_online(online: DataFrame, entity_type: str, features: Sequence[str] | None = None,
                as_of: Instant = None) -> DataFrame:
    """Live keyed online rows of a type as tall offline rows.

    Expired rows, keys of another shape, empty values and text that is not JSON are left out.
    """
    ids = ENTITY_IDS[entity_type]
    of_type = live(online, as_of).filter(F.col("key").startswith(entity_type + ":"))
    good = of_type.filter(key_has_shape(F.col("key"), len(ids)) & is_json(F.col("value")))
    parts = key_parts(F.col("key"))
    out = good.select(*[parts[i + 1].alias(c) for i, c in enumerate(ids)],
                      parts[len(ids) + 1].alias("feature_name"),
                      F.col("value").alias("feature_value"), F.col("written_at").alias("timestamp"))
    if features is not None:
        out = out.filter(F.col("feature_name").isin(list(features)))
    return out


def to_offline(offline: DataFrame, online: DataFrame, entity_type: str,
               features: Sequence[str] | None = None, as_of: Instant = None) -> DataFrame:
    """The offline table after writing the live online values back under their own timestamps."""
    keys = [*ENTITY_IDS[entity_type], "feature_name", "timestamp"]
    return upsert(offline, from_online(online, entity_type, features, as_of), keys, ["feature_value"])


def run(offline: dict[str, DataFrame], online: DataFrame, direction: str = "both",
        entity_types: Sequence[str] = tuple(ENTITY_IDS), since_hours: float = 24,
        as_of: Instant = None, features: dict[str, Sequence[str]] | None = None
        ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The online table and the offline tables after a run; online is written first."""
    if direction not in ("online", "offline", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    offline = dict(offline)
    for kind in entity_types:
        names = (features or {}).get(kind)
        if direction in ("online", "both"):
            fresh = to_online(offline[kind], kind, since_hours, as_of, names)
            online = upsert(online, fresh, ["key"], ["written_at"])
        if direction in ("offline", "both"):
            offline[kind] = to_offline(offline[kind], online, kind, names, as_of)
    return online, offline
