"""Upkeep of stored tables: retention, expiry, compaction."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from featloom.functions.time import Instant
from featloom.operators.latest import latest_by_key, retain
from featloom.plans.feature_store import live
from featloom.plans.star import FEATURE_VALUE_DAYS, PREDICTION_DAYS
from featloom.sinks.keyed import KeyedTable


def retain_feature_values(facts: DataFrame, as_of: Instant = None, moment: str = "created_at") -> DataFrame:
    return retain(facts, moment, FEATURE_VALUE_DAYS, as_of)


def retain_predictions(facts: DataFrame, as_of: Instant = None, moment: str = "created_at") -> DataFrame:
    return retain(facts, moment, PREDICTION_DAYS, as_of)


def compact(online: DataFrame, keys: Sequence[str], order: Sequence[str], as_of: Instant = None) -> DataFrame:
    """One live row per key: older versions and expired rows removed.

    The latest version is chosen first, so an expired latest value does not bring an
    older one back.
    """
    return live(latest_by_key(online, keys, order), as_of)


def retire(table: KeyedTable, moment: str, days: int, as_of: str | dt.datetime) -> int:
    """Retention of a keyed table whose leading column is the date of `moment`; gives the version.

    Expired days leave without being read, and of the day of the cut only its own rows are rewritten. Rows
    without a moment stay.
    """
    now = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    cut = now - dt.timedelta(days=days)
    return table.drop_before(cut.date().isoformat(), F.col(moment) >= F.lit(cut.isoformat(" ")).cast("timestamp_ntz"))
