"""The feature registry, with definitions told by the part table and groups by the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featloom.catalog.base import ORDERS_AS_OF, Tables, query
from featloom.plans import profile, registry as R
from featloom.schemas import VERSIONS

NOW = f"TIMESTAMP '{ORDERS_AS_OF}'"


def _pick(column: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


VALUE_TYPES = ("INT", "FLOAT", "STRING", "BOOL")
CATEGORIES = ("RAW", "DERIVED", "ENGINEERED", "TARGET")


def definitions(t: Tables) -> DataFrame:
    """One definition per part; its versions are 1 to p_size % 4."""
    count = (F.col("p_size") % 4).cast("int")
    version = lambda i: F.struct(
        i.alias("version"), F.when(i == count, "ACTIVE").otherwise("DEPRECATED").alias("status"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("created_at"))
    versions = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), version))
    return t.raw("part").select(
        F.concat(F.lit("feature_"), F.col("p_partkey")).alias("name"), F.col("p_name").alias("description"),
        F.lower("p_type").alias("entity_type"), _pick("p_partkey", VALUE_TYPES).alias("value_type"),
        F.lit("BATCH").alias("source"), _pick("p_size", CATEGORIES).alias("category"),
        F.lit("DAILY").alias("frequency"), F.col("p_brand").alias("owner"),
        F.split("p_name", " ").alias("tags"),
        F.coalesce(versions, F.array()).cast(VERSIONS).alias("versions"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("created_at"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("updated_at"))


SQL_DEFS = """(SELECT p_partkey, 'feature_' || p_partkey AS name, p_name AS description, lower(p_type) AS entity_type,
  (['INT', 'FLOAT', 'STRING', 'BOOL'])[CAST(p_partkey % 4 + 1 AS INTEGER)] AS value_type,
  (['RAW', 'DERIVED', 'ENGINEERED', 'TARGET'])[CAST(p_size % 4 + 1 AS INTEGER)] AS category,
  p_brand AS owner, CAST(p_size % 4 AS INTEGER) AS top_version FROM part)"""


def incoming(t: Tables) -> DataFrame:
    """Definitions sent in by suppliers: some names are taken, some value types are not allowed."""
    key = F.col("s_suppkey")
    name = F.when(key % 2 == 0, F.concat(F.lit("feature_"), key)).otherwise(F.concat(F.lit("new_"), key))
    return t.raw("supplier").select(
        name.alias("name"), F.col("s_name").alias("description"), F.lit("supplier").alias("entity_type"),
        F.when(key % 5 == 0, "TENSOR").otherwise("FLOAT").alias("value_type"), F.lit("DERIVED").alias("source"),
        F.lit("BEHAVIORAL").alias("category"), F.lit("DAILY").alias("frequency"), F.lit("team").alias("owner"),
        F.array(F.lit("new")).alias("tags"))


SQL_CHECKED = """(SELECT name, s_name AS description, CASE WHEN s_suppkey % 5 = 0 THEN 422
  WHEN EXISTS (SELECT 1 FROM part WHERE 'feature_' || p_partkey = name) THEN 409 ELSE 201 END AS status_code,
  CASE WHEN s_suppkey % 5 = 0 THEN 'value_type'
  WHEN EXISTS (SELECT 1 FROM part WHERE 'feature_' || p_partkey = name) THEN 'already exists' END AS reason
  FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'feature_' ELSE 'new_' END || s_suppkey AS name FROM supplier))"""


@query(f"SELECT name, description, status_code, reason FROM {SQL_CHECKED}")
def registry_check(t: Tables) -> DataFrame:
    return R.check_new(incoming(t), definitions(t)).select("name", "description", "status_code", "reason")


@query(f"""SELECT name, description, top_version AS versions, TIMESTAMP '2001-01-01' AS updated_at FROM {SQL_DEFS}
UNION ALL SELECT name, description, 1, {NOW} FROM {SQL_CHECKED} WHERE status_code = 201""")
def registry_register(t: Tables) -> DataFrame:
    done = R.register(incoming(t), definitions(t), ORDERS_AS_OF)
    return done.select("name", "description", F.size("versions").alias("versions"), "updated_at")


@query("""SELECT 'repeat_' || (o_custkey % 500) AS name, o_orderkey AS sent, CASE WHEN o_orderkey % 9 = 0 THEN 422
WHEN row_number() OVER (PARTITION BY o_custkey % 500, o_orderkey % 9 = 0 ORDER BY o_orderkey) > 1 THEN 409 ELSE 201 END AS status_code
FROM orders""")
def registry_repeated_names(t: Tables) -> DataFrame:
    """Many rows of one name in a batch: the first good one is accepted."""
    k = F.col("o_orderkey")
    batch = t.raw("orders").select(
        F.concat(F.lit("repeat_"), F.col("o_custkey") % 500).alias("name"), k.alias("sent"), F.lit("order").alias("entity_type"),
        F.when(k % 9 == 0, "TENSOR").otherwise("FLOAT").alias("value_type"), F.lit("BATCH").alias("source"),
        F.lit("RAW").alias("category"), F.lit("DAILY").alias("frequency"))
    return R.check_new(batch, definitions(t), order=["sent"]).select("name", "sent", "status_code")


@query(f"""SELECT name, value_type, owner FROM {SQL_DEFS} WHERE entity_type = 'economy' AND category = 'DERIVED'""")
def registry_filter(t: Tables) -> DataFrame:
    return R.list_features(definitions(t), "economy", "DERIVED").select("name", "value_type", "owner")


@query(f"""SELECT entity_type, category, COUNT(*) AS features FROM {SQL_DEFS} GROUP BY 1, 2""")
def registry_counts(t: Tables) -> DataFrame:
    return R.list_features(definitions(t)).groupBy("entity_type", "category").agg(F.count(F.lit(1)).alias("features"))


def doomed(t: Tables) -> DataFrame:
    """Names to delete: one per supplier, half of them unknown."""
    return t.raw("supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "feature_").otherwise("nothing_"),
                                             F.col("s_suppkey") * 3).alias("name"))


SQL_DOOMED = """(SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'feature_' ELSE 'nothing_' END || (s_suppkey * 3) AS name
  FROM supplier)"""


@query(f"""SELECT 'remaining' AS kind, name, CAST(NULL AS BOOLEAN) AS found FROM {SQL_DEFS}
WHERE name NOT IN (SELECT name FROM {SQL_DOOMED})
UNION ALL SELECT 'asked', name, name IN (SELECT name FROM {SQL_DEFS}) FROM {SQL_DOOMED}""")
def registry_delete(t: Tables) -> DataFrame:
    remaining, outcome = R.delete(definitions(t), doomed(t))
    return (remaining.select(F.lit("remaining").alias("kind"), "name", F.lit(None).cast("boolean").alias("found"))
            .unionByName(outcome.select(F.lit("asked").alias("kind"), "name", "found")))


def groups(t: Tables) -> DataFrame:
    """One group of three features per order; every 10th order names two nobody registered."""
    k = F.col("o_orderkey")
    second = F.when(k % 10 == 0, F.lit("ghost_2")).otherwise(F.concat(F.lit("feature_"), k % 200))
    third = F.when(k % 10 == 0, F.lit("ghost_1")).otherwise(F.concat(F.lit("feature_"), k % 7))
    return t.raw("orders").select(
        F.concat(F.lit("group_"), k).alias("name"), F.lit("from orders").alias("description"),
        F.array(F.concat(F.lit("feature_"), F.col("o_custkey") % 100), second, third).alias("feature_names"),
        F.lit("mixed").alias("entity_type"), F.lit("team").alias("owner"))


def known_groups(t: Tables) -> DataFrame:
    at = F.lit("2001-01-01").cast("timestamp_ntz")
    return t.raw("customer").select(
        F.concat(F.lit("group_"), F.col("c_custkey") * 7).alias("name"), F.col("c_name").alias("description"),
        F.array(F.lit("feature_0")).alias("feature_names"), F.lit("customer").alias("entity_type"),
        F.lit("team").alias("owner"), at.alias("created_at"), at.alias("updated_at"))


SQL_GROUPS = """(SELECT o_orderkey, 'group_' || o_orderkey AS name, CAST(3 AS BIGINT) AS members,
  CASE WHEN o_orderkey % 10 = 0 THEN 'ghost_1,ghost_2' END AS missing,
  CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey * 7 = o_orderkey) THEN 409
       WHEN o_orderkey % 10 = 0 THEN 404 ELSE 201 END AS status_code FROM orders)"""


@query(f"SELECT name, members, missing, status_code FROM {SQL_GROUPS}")
def registry_group_check(t: Tables) -> DataFrame:
    return R.check_groups(groups(t), definitions(t), known_groups(t)).select(
        "name", F.size("feature_names").cast("bigint").alias("members"),
        F.array_join("missing", ",").alias("missing"), "status_code")


@query(f"""SELECT name, members, {NOW} AS updated_at FROM {SQL_GROUPS} WHERE status_code = 201
UNION ALL SELECT 'group_' || (c_custkey * 7), 1, TIMESTAMP '2001-01-01' FROM customer""")
def registry_register_groups(t: Tables) -> DataFrame:
    return R.register_groups(groups(t), definitions(t), known_groups(t), ORDERS_AS_OF).select(
        "name", F.size("feature_names").cast("bigint").alias("members"), "updated_at")


@query(f"""SELECT 'group_' || o_orderkey AS group_name, d.name, value_type FROM (
SELECT o_orderkey, unnest(['feature_' || (o_custkey % 100), CASE WHEN o_orderkey % 10 <> 0 THEN 'feature_' || (o_orderkey % 200) END,
  CASE WHEN o_orderkey % 10 <> 0 THEN 'feature_' || (o_orderkey % 7) END]) AS name FROM orders) m JOIN {SQL_DEFS} d ON m.name = d.name"""
)
def registry_group_features(t: Tables) -> DataFrame:
    return R.group_features(groups(t), definitions(t)).select("group_name", "name", "value_type")


@query(f"""SELECT name, CASE WHEN name IN (SELECT name FROM {SQL_DOOMED}) THEN top_version + 1 ELSE top_version END AS versions,
CASE WHEN name IN (SELECT name FROM {SQL_DOOMED}) THEN {NOW} ELSE TIMESTAMP '2001-01-01' END AS updated_at FROM {SQL_DEFS}""")
def registry_version(t: Tables) -> DataFrame:
    grown = R.add_versions(definitions(t), doomed(t), ORDERS_AS_OF)
    top = F.coalesce(F.array_max(F.transform("versions", lambda v: v["version"])), F.lit(0))
    return grown.select("name", top.alias("versions"), "updated_at")


@query(f"""SELECT name, CAST(v AS INTEGER) AS version, TIMESTAMP '2001-01-01' AS created_at
FROM (SELECT name, top_version, unnest(range(1, top_version + 1)) AS v FROM {SQL_DEFS}) WHERE v < top_version""")
def registry_deprecated_versions(t: Tables) -> DataFrame:
    return R.versions_with_status(definitions(t), "DEPRECATED")


@query(f"""SELECT name, description, {NOW} AS updated_at FROM (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'feature_' ELSE 'new_' END || s_suppkey AS name, s_name AS description FROM supplier)
UNION ALL SELECT name, description, TIMESTAMP '2001-01-01' FROM {SQL_DEFS} WHERE name NOT IN
  (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'feature_' ELSE 'new_' END || s_suppkey FROM supplier)""")
def registry_save(t: Tables) -> DataFrame:
    at = F.lit("2001-07-01").cast("timestamp_ntz")
    sent = incoming(t).withColumn("versions", R.first_version("2001-07-01 00:00:00")).withColumn("created_at", at)
    return R.save(definitions(t), sent.withColumn("updated_at", at), ORDERS_AS_OF).select("name", "description", "updated_at")


@query("""SELECT column_name, mean, unique_count, owner FROM (
 SELECT 'p_size' AS column_name, ROUND(AVG(p_size), 6) AS mean, COUNT(DISTINCT p_size) AS unique_count, MIN(p_brand) AS owner FROM part
 UNION ALL SELECT 'p_retailprice', ROUND(AVG(p_retailprice), 6), COUNT(DISTINCT p_retailprice), MIN(p_brand) FROM part)""")
def registry_stats(t: Tables) -> DataFrame:
    part = t.raw("part")
    named = part.agg(F.min("p_brand").alias("owner")).select(
        F.explode(F.array(F.lit("p_size"), F.lit("p_retailprice"))).alias("name"), "owner")
    got = R.with_stats(named, profile.profile(part, ["p_size", "p_retailprice"]))
    return got.select(F.col("name").alias("column_name"), F.round("mean", 6).alias("mean"), "unique_count", "owner")
