"""The feature registry: definitions and groups as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featloom.functions.time import Instant, instant
from featloom.functions.values import VALUE_TYPES
from featloom.operators.latest import upsert
from featloom.operators.nesting import repeated
from featloom.schemas import VERSIONS
from featloom.session import written

# Allowed values of a definition. The second line of a set holds values the
# sample definitions use beyond the declared ones.
SOURCES = ("BATCH", "STREAMING", "ONLINE", "DERIVED")
CATEGORIES = ("RAW", "DERIVED", "ENGINEERED", "TARGET",
              "BEHAVIORAL", "POPULARITY", "INTERACTION", "CONVERSION")
FREQUENCIES = ("REAL_TIME", "HOURLY", "DAILY", "WEEKLY", "MONTHLY", "YEARLY", "STATIC")
STATUSES = ("ACTIVE", "DEPRECATED", "ARCHIVED")

ALLOWED = {
    "value_type": tuple(VALUE_TYPES), "source": SOURCES,
    "category": CATEGORIES, "frequency": FREQUENCIES,
}


def invalid_reason() -> Column:
    """The first field of a definition that does not hold an allowed value, else NULL."""
    checks = [F.when(F.col("name").isNull() | (F.col("name") == ""), F.lit("name"))]
    checks += [F.when(~F.col(c).isin(*values) | F.col(c).isNull(), F.lit(c))
               for c, values in ALLOWED.items()]
    return F.coalesce(*checks)


def _once(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with status 409 instead of 201 on all but the first new row of a name.

    The first one has the least `order`; rows that it leaves equal go by their JSON text, and of copies one is
    the first. `rows` are written, since several parts need them. Good rows are counted by name; only those of a name
    that several share are compared, in every task before they meet, and copies are counted, so a name that many
    rows share is no group of one task.
    """
    rows = written(rows, "checked")
    good = F.col("status_code") == 201
    text = F.to_json(F.struct(*[c for c in rows.columns if c not in ("status_code", "reason", "missing")]))
    place = F.struct(*[F.col(c) for c in order], text)
    shared = (rows.filter(good).groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("_rivals"))
              .filter("_rivals > 1").select("_name"))
    shared = written(shared, "shared-names")
    named = F.col("name") == F.col("_name")
    alone = rows.join(shared, good & named, "left_anti")
    rivals = rows.filter(good).join(shared, named, "left_semi")
    firsts = rivals.groupBy(F.col("name").alias("_name")).agg(F.min(place).alias("_first"))
    met = rivals.join(firsts, named)
    first = place == F.col("_first")
    one = met.filter(first).groupBy(*rows.columns).agg((F.count(F.lit(1)) - 1).alias("_others"))
    parts = [alone.select("*", F.lit(False).alias("_taken")), met.filter(~first).select(*rows.columns, F.lit(True).alias("_taken")),
             one.select(*rows.columns, F.lit(False).alias("_taken")),
             repeated(one, "_others").select(*rows.columns, F.lit(True).alias("_taken"))]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("status_code", F.when(F.col("_taken"), 409).otherwise(F.col("status_code")))


def check_new(incoming: DataFrame, registry: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Incoming definitions with status 201, 409 (name taken) or 422 (bad value) and a reason.

    A name is taken by the registry, or by an earlier good row of the batch in the given
    `order`.
    """
    problem = invalid_reason()
    names = registry.select("name", F.lit(True).alias("_known"))
    checked = (incoming.join(names, "name", "left").withColumn("reason", problem)
               .withColumn("status_code", F.when(F.col("reason").isNotNull(), 422)
                           .when(F.col("_known"), 409).otherwise(201)).drop("_known"))
    return (_once(checked, order)
            .withColumn("reason", F.when(F.col("status_code") == 409, F.lit("already exists")).otherwise(F.col("reason")))
            .drop("_taken"))


def first_version(as_of: Instant = None) -> Column:
    return F.array(F.struct(F.lit(1).alias("version"), F.lit("ACTIVE").alias("status"),
                            instant(as_of, "timestamp_ntz").alias("created_at"))).cast(VERSIONS)


def register(incoming: DataFrame, registry: DataFrame, as_of: Instant = None,
             order: Sequence[str] = ()) -> DataFrame:
    """The registry with the accepted definitions added at version 1."""
    now = instant(as_of, "timestamp_ntz")
    accepted = check_new(incoming, registry, order).filter(F.col("status_code") == 201)
    given = accepted.columns
    versions = (F.when(F.size("versions") > 0, F.col("versions")).otherwise(first_version(as_of))
                if "versions" in given else first_version(as_of))
    new = accepted.withColumn("versions", versions).withColumn("updated_at", now)
    new = new.withColumn("created_at", F.coalesce("created_at", now) if "created_at" in given else now)
    return registry.unionByName(new.select(*registry.columns))


def save(registry: DataFrame, definitions: DataFrame, as_of: Instant = None) -> DataFrame:
    """Insert or replace by name; `updated_at` is set on the written rows."""
    return upsert(registry, definitions, ["name"], updated_at="updated_at", as_of=as_of)


def get(registry: DataFrame, name: str) -> DataFrame:
    """The definition, or the group, of a name."""
    return registry.filter(F.col("name") == name)


def load(spark: SparkSession, features_path: str, groups_path: str) -> tuple[DataFrame, DataFrame]:
    """The whole registry: definitions and groups, as stored by `store`."""
    return spark.read.parquet(features_path), spark.read.parquet(groups_path)


def store(registry: DataFrame, groups: DataFrame, features_path: str, groups_path: str) -> None:
    """Write the whole registry to new places."""
    registry.write.mode("error").parquet(features_path)
    groups.write.mode("error").parquet(groups_path)


def list_features(registry: DataFrame, entity_type: str | None = None,
                  category: str | None = None) -> DataFrame:
    """Definitions that match every filter given."""
    for column, wanted in (("entity_type", entity_type), ("category", category)):
        if wanted is not None:
            registry = registry.filter(F.col(column) == wanted)
    return registry


def delete(registry: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry without `names`, and each name with whether it was found."""
    remaining = registry.join(names.select("name"), "name", "left_anti").select(*registry.columns)
    known = registry.select("name", F.lit(True).alias("_known"))
    outcome = (names.select("name").distinct().join(known, "name", "left")
               .select("name", F.coalesce("_known", F.lit(False)).alias("found")))
    return remaining, outcome


def list_groups(groups: DataFrame, entity_type: str | None = None, owner: str | None = None) -> DataFrame:
    """Groups that match every filter given."""
    for column, wanted in (("entity_type", entity_type), ("owner", owner)):
        if wanted is not None:
            groups = groups.filter(F.col(column) == wanted)
    return groups


def check_groups(groups: DataFrame, registry: DataFrame, known_groups: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Groups with status 201, 409 (name taken) or 404 and the feature names nobody registered.

    A name is taken by a known group, or by an earlier good row of the batch.
    """
    members = groups.select("name", F.explode("feature_names").alias("feature_name"))
    # each name is looked up once, however many groups have it
    nowhere = members.select("feature_name").distinct().join(registry.select(F.col("name").alias("feature_name")), "feature_name", "left_anti")
    absent = members.join(nowhere, "feature_name", "left_semi")
    # an array no longer than the group's own list of names
    per_group = absent.groupBy("name").agg(F.array_sort(F.collect_set("feature_name")).alias("missing"))
    names = known_groups.select("name", F.lit(True).alias("_known"))
    checked = (groups.join(per_group, "name", "left").join(names, "name", "left")
               # what another row of the name misses is not this row's fault
               .withColumn("missing", F.array_intersect("missing", "feature_names"))
               .withColumn("missing", F.when(F.size("missing") > 0, F.col("missing")))
               .withColumn("status_code", F.when(F.col("_known"), 409)
                           .when(F.col("missing").isNotNull(), 404).otherwise(201))
               .drop("_known"))
    return _once(checked, order).drop("_taken")


def register_groups(groups: DataFrame, registry: DataFrame, known_groups: DataFrame,
                    as_of: Instant = None, order: Sequence[str] = ()) -> DataFrame:
    now = instant(as_of, "timestamp_ntz")
    accepted = check_groups(groups, registry, known_groups, order).filter(F.col("status_code") == 201)
    new = accepted.withColumn("created_at", now).withColumn("updated_at", now)
    return known_groups.unionByName(new.select(*known_groups.columns))


def group_features(groups: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per group and registered member feature."""
    members = groups.select(F.col("name").alias("group_name"), F.explode("feature_names").alias("name"))
    return members.join(registry, "name")


def next_version() -> Column:
    """The greatest version so far plus one, 1 for a definition without versions."""
    top = F.array_max(F.transform("versions", lambda v: v["version"]))
    return F.coalesce(top + 1, F.lit(1))


def add_versions(registry: DataFrame, names: DataFrame, as_of: Instant = None) -> DataFrame:
    """The registry with a new active version on each named definition."""
    now = instant(as_of, "timestamp_ntz")
    entry = F.array(F.struct(next_version().alias("version"), F.lit("ACTIVE").alias("status"),
                             now.alias("created_at"))).cast(VERSIONS)
    marked = registry.join(names.select("name").distinct().withColumn("_new", F.lit(True)), "name", "left")
    grown = F.concat(F.coalesce("versions", F.array().cast(VERSIONS)), entry)
    return (marked.withColumn("versions", F.when(F.col("_new"), grown).otherwise(F.col("versions")))
            .withColumn("updated_at", F.when(F.col("_new"), now).otherwise(F.col("updated_at")))
            .select(*registry.columns))


def versions_with_status(registry: DataFrame, status: str = "ACTIVE") -> DataFrame:
    """One row per definition and version in the given status."""
    return (registry.select("name", F.explode("versions").alias("v"))
            .filter(F.col("v.status") == status)
            .select("name", F.col("v.version").alias("version"), F.col("v.created_at").alias("created_at")))


def with_stats(registry: DataFrame, profile: DataFrame) -> DataFrame:
    """Definitions with the profile of their values (see `plans.profile`)."""
    return registry.join(profile.withColumnRenamed("column_name", "name"), "name", "left")
