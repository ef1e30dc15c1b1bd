"""Online and historical feature values.

The online table holds `(entity_type, entity_id, feature_name, value, written_at,
expires_at)` with values as text; history holds `(entity_id, entity_type, data,
timestamp)` with one JSON text per write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from featloom.functions.time import Instant, instant, instant_like, interval
from featloom.functions.values import (
    as_number, decoded_text, encode, is_present, typed,
)
from featloom.operators.intervals import SLICE_SECONDS, as_of_join
from featloom.operators.latest import in_time_range, merge_latest, top_n_by_key
from featloom.schemas import FEATURE_TTL
from featloom.sinks.keyed import KeyedTable

#: History rows of one entity, unless asked otherwise.
HISTORY_ROWS = 100
ONLINE_KEY = ("entity_type", "entity_id", "feature_name")


def _not_features(df: DataFrame, id_column: str, written_at: str | None) -> list[str]:
    skip = {id_column, "entity_type", written_at}
    return [c for c in df.columns if c not in skip]


def to_online(df: DataFrame, entity_type: str | None = None, id_column: str = "entity_id",
              features: Sequence[str] | None = None, ttl_seconds: int | None = None,
              written_at: str | None = None, as_of: Instant = None,
              keep_nulls: bool = False) -> DataFrame:
    """Wide feature rows as online rows, one per value.

    Rows without an id are left out. NULL and NaN values are left out too, or kept as
    JSON `null` with `keep_nulls`. `entity_type` None reads the type from the column.
    """
    features = list(features or _not_features(df, id_column, written_at))
    kind = F.lit(entity_type) if entity_type else F.col("entity_type")
    moment = F.col(written_at).cast("timestamp_ntz") if written_at else instant(as_of, "timestamp_ntz")
    expires = moment + interval(ttl_seconds, "second") if ttl_seconds else F.lit(None).cast("timestamp_ntz")
    cells = []
    for f in features:
        t = df.schema[f].dataType
        text = F.when(is_present(F.col(f), t), encode(F.col(f), t))
        cells.append(F.struct(F.lit(f).alias("feature_name"), text.alias("value")))
    out = df.filter(F.col(id_column).isNotNull() & (F.col(id_column).cast("string") != "")).select(
        kind.alias("entity_type"), F.col(id_column).cast("string").alias("entity_id"),
        moment.alias("written_at"), expires.alias("expires_at"),
        F.explode(F.array(*cells)).alias("_cell"))
    value = F.coalesce("_cell.value", F.lit("null")) if keep_nulls else F.col("_cell.value")
    out = out.select("entity_type", "entity_id", "_cell.feature_name", value.alias("value"),
                     "written_at", "expires_at")
    return out if keep_nulls else out.filter(F.col("value").isNotNull())


def store_features_batch(df: DataFrame, entity_type: str, as_of: Instant = None,
                         order: Sequence[str] = ()) -> DataFrame:
    """Batch features as online rows with seven days to live; the last row of an id wins.

    The last row is the one with the greatest `order` columns, which are no features; rows
    that these leave equal go by their JSON text. It wins as a whole: its NULL values do not
    let those of an earlier row through.
    """
    id_column = f"{entity_type}_id" if entity_type in ("customer", "product") else "entity_id"
    last = [*(F.col(c).desc() for c in order), F.to_json(F.struct(*df.columns)).desc()]
    rows = top_n_by_key(df.filter(F.col(id_column).isNotNull()), [id_column], last, 1).drop(*order)
    return to_online(rows, entity_type, id_column, ttl_seconds=FEATURE_TTL, as_of=as_of)


def materialize_query(spark: SparkSession, query: str, ttl_seconds: int | None = None,
                      as_of: Instant = None) -> DataFrame:
    """Any SQL that gives entity_id, entity_type and feature columns, as online rows."""
    return to_online(spark.sql(query), ttl_seconds=ttl_seconds, as_of=as_of, keep_nulls=True)


def live(online: DataFrame, as_of: Instant = None) -> DataFrame:
    """Rows whose time to live has not run out."""
    now = instant_like(online, "expires_at", as_of)
    return online.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def merge_online(online: DataFrame, updates: DataFrame) -> DataFrame:
    """The online table, one row per key, after writing `updates`: the latest write of a key wins."""
    return merge_latest(online, updates, ONLINE_KEY, ["written_at", "value"])


def read_online(keys: DataFrame, online: DataFrame, features: Sequence[str], entity_type: str,
                as_of: Instant = None) -> DataFrame:
    """Every requested entity with one text column per feature and the list of missing ones.

    The latest write of a feature counts (of writes at one time the greatest text, then the
    longest to live), and is missing once it has expired: an older one does not come back.
    The latest value per feature and the pivot are one aggregation with map-side
    combining; requested entities are never multiplied by feature names.
    """
    wanted = online.filter((F.col("entity_type") == entity_type) & F.col("feature_name").isin(list(features)))
    cell = F.struct("written_at", "value", F.col("expires_at").isNull().alias("forever"), "expires_at")
    latest = wanted.groupBy("entity_id").agg(
        *[F.max(F.when(F.col("feature_name") == f, cell)).alias(f) for f in features])
    now = instant_like(online, "expires_at", as_of)
    alive = lambda f: F.col(f)["forever"] | (F.col(f)["expires_at"] > now)
    wide = latest.select("entity_id", *[F.when(alive(f), F.col(f)).alias(f) for f in features])
    found = keys.select(F.col("entity_id").cast("string").alias("entity_id")).distinct().join(
        wide, "entity_id", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in features]))
    return found.select("entity_id", *[F.col(f)["value"].alias(f) for f in features],
                        missing.alias("missing_features"))


def online_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """An empty online store in files, which can be scanned by entity type and looked up by key."""
    schema = ("entity_type string, entity_id string, feature_name string, value string, written_at timestamp_ntz, "
              "expires_at timestamp_ntz")
    return KeyedTable.create(spark, path, spark.createDataFrame([], schema).schema, ONLINE_KEY, buckets,
                             ("written_at", "value"), "entity_type")


def read_online_table(keys: DataFrame, table: KeyedTable, features: Sequence[str], entity_type: str,
                      as_of: Instant = None) -> DataFrame:
    """`read_online` that reads only the files of the requested keys."""
    wanted = keys.select(F.lit(entity_type).alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"),
                         F.explode(F.array(*map(F.lit, features))).alias("feature_name"))
    return read_online(keys, table.lookup(wanted), features, entity_type, as_of)


def read_typed(keys: DataFrame, online: DataFrame, value_types: dict[str, str], entity_type: str,
               as_of: Instant = None) -> DataFrame:
    """`read_online` with each value read as its registered type."""
    got = read_online(keys, online, list(value_types), entity_type, as_of)
    return got.select("entity_id", *[typed(F.col(f), t).alias(f) for f, t in value_types.items()],
                      "missing_features")


def feature_vectors(keys: DataFrame, online: DataFrame, features: Sequence[str], entity_type: str,
                    as_of: Instant = None) -> DataFrame:
    """Model input: numbers as doubles in request order; other values stay as text in a map."""
    got = read_online(keys, online, features, entity_type, as_of)
    number = {f: as_number(F.col(f)) for f in features}
    left_as_is = [F.struct(F.lit(f).alias("key"),
                           F.when(number[f].isNull(), decoded_text(F.col(f))).alias("value"))
                  for f in features]
    texts = F.map_from_entries(F.filter(F.array(*left_as_is), lambda e: e["value"].isNotNull()))
    return got.select("entity_id", *[number[f].alias(f) for f in features],
                      F.array(*[number[f] for f in features]).alias("vector"),
                      texts.alias("non_numeric"), "missing_features")


def to_history(df: DataFrame, entity_type: str | None = None, id_column: str = "entity_id",
               features: Sequence[str] | None = None, timestamp: str | None = None,
               as_of: Instant = None) -> DataFrame:
    """Wide feature rows as history rows; NULL values are kept in the JSON text."""
    features = list(features or _not_features(df, id_column, timestamp))
    kind = F.lit(entity_type) if entity_type else F.col("entity_type")
    now = instant(as_of, "timestamp_ntz")
    moment = F.coalesce(F.col(timestamp).cast("timestamp_ntz"), now) if timestamp else now
    return df.select(F.col(id_column).cast("string").alias("entity_id"), kind.alias("entity_type"),
                     F.to_json(F.struct(*features), {"ignoreNullFields": "false"}).alias("data"),
                     moment.alias("timestamp"))


def write_both(df: DataFrame, entity_type: str, id_column: str = "entity_id",
               features: Sequence[str] | None = None, ttl_seconds: int | None = None,
               as_of: Instant = None) -> tuple[DataFrame, DataFrame]:
    """Online and history rows of one write."""
    return (to_online(df, entity_type, id_column, features, ttl_seconds, as_of=as_of, keep_nulls=True),
            to_history(df, entity_type, id_column, features, as_of=as_of))


def read_history(history: DataFrame, features: Sequence[str], entity_type: str,
                 entity_id: str | None = None, start: Instant = None, end: Instant = None,
                 limit: int | None = None) -> DataFrame:
    """The newest history rows of an entity, 100 if no `limit` is given, or those of every
    entity: all of them, or `limit` for each. The chosen features are text columns; the
    JSON text is parsed once per row."""
    rows = in_time_range(history.filter(F.col("entity_type") == entity_type), "timestamp", start, end)
    if entity_id is not None:
        rows = (rows.filter(F.col("entity_id") == entity_id)
                .orderBy(F.col("timestamp").desc(), F.col("data").desc()).limit(limit or HISTORY_ROWS))
    elif limit is not None:
        rows = top_n_by_key(rows, ["entity_id"],
                            [F.col("timestamp").desc(), F.col("data").desc()], limit)
    parsed = F.from_json("data", ", ".join(f"`{f}` string" for f in features))
    return rows.select("entity_id", "timestamp", parsed.alias("_d")).select(
        "entity_id", "timestamp", *[F.col("_d")[f].alias(f) for f in features])


def point_in_time(labels: DataFrame, history: DataFrame, features: Sequence[str],
                  entity_type: str, label_time: str = "label_time", strict: bool = False,
                  slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Training rows: each label with the feature values known at its time."""
    parsed = F.from_json("data", ", ".join(f"`{f}` string" for f in features))
    known = (history.filter(F.col("entity_type") == entity_type)
             .select("entity_id", "timestamp", "data", parsed.alias("_d"))
             .select("entity_id", "timestamp", "data", *[F.col("_d")[f].alias(f) for f in features]))
    return as_of_join(labels, known, ["entity_id"], label_time, "timestamp",
                      ["timestamp", *features], strict, ["data"], slice_seconds)

