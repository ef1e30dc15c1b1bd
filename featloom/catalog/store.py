"""Online and offline feature values, materialization, point-in-time reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.catalog.base import (
    EVENTS_AS_OF, ORACLES, ORDERS_AS_OF, SQL_TALL, Tables, query,
)
from featloom.operators import intervals, latest
from featloom.plans import feature_store as S, maintain, materialize as M
from featloom.session import scratch_dir
from featloom.sinks.keyed import KeyedTable
from featloom.sources.tables import register_views

NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"
FEATURES = ["view", "click", "purchase", "absent"]


def online(t: Tables) -> DataFrame:
    """Every event as an online write of its type's feature, one to seven days to live, or for ever."""
    return t.events().select(
        F.lit("customer").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"),
        F.col("event_type").alias("feature_name"), F.col("value").cast("string").alias("value"),
        F.col("ts").alias("written_at"),
        F.expr("if(event_id % 8 = 0, NULL, ts + make_dt_interval(cast(event_id % 8 as int)))").alias("expires_at"))


SQL_ONLINE = """(SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name, value, ts AS written_at,
  CASE WHEN event_id % 8 <> 0 THEN ts + to_days(CAST(event_id % 8 AS INTEGER)) END AS expires_at FROM events)"""
SQL_LIVE = f"""(SELECT entity_id, feature_name, value FROM (SELECT *, row_number() OVER
  (PARTITION BY entity_id, feature_name ORDER BY written_at DESC) AS n FROM {SQL_ONLINE})
  WHERE n = 1 AND (expires_at IS NULL OR expires_at > {NOW}))"""


def keys(t: Tables) -> DataFrame:
    """All customers ask; most have no events."""
    return t.raw("customer").select(F.col("c_custkey").cast("string").alias("entity_id"))


@query(f"""SELECT customer_id, feature_name, feature_value, "timestamp" FROM (
SELECT *, row_number() OVER (PARTITION BY customer_id, feature_name ORDER BY "timestamp" DESC, feature_value DESC) AS n
FROM {SQL_TALL}) WHERE n = 1""")
def latest_features(t: Tables) -> DataFrame:
    return latest.latest_by_key(t.tall_features(), ["customer_id", "feature_name"], ["timestamp", "feature_value"])


@query(f"""SELECT customer_id, feature_name, feature_value, "timestamp" FROM (
SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC, feature_value DESC) AS n
FROM {SQL_TALL}) WHERE n <= 5""")
def newest_five(t: Tables) -> DataFrame:
    return latest.top_n_by_key(t.tall_features(), ["customer_id"],
                               [F.col("timestamp").desc(), F.col("feature_value").desc()], 5)


@query(f"""SELECT 'customer:' || customer_id || ':' || feature_name AS key,
arg_max(feature_value, "timestamp") AS value, MAX("timestamp") AS written_at, {NOW} + INTERVAL 7 DAY AS expires_at
FROM {SQL_TALL} WHERE "timestamp" >= {NOW} - INTERVAL 96 HOUR GROUP BY customer_id, feature_name""")
def materialize_online(t: Tables) -> DataFrame:
    return M.to_online(t.tall_features(), "customer", 96, EVENTS_AS_OF)


def tall_pairs(t: Tables) -> DataFrame:
    return t.events().select(
        F.col("user_id").alias("customer_id"), F.get_json_object("props", "$.k").alias("product_id"),
        F.col("event_type").alias("feature_name"), F.col("value").cast("string").alias("feature_value"),
        F.col("ts").alias("timestamp"))


@query(f"""SELECT 'customer_product:' || user_id || ':' || json_extract_string(props, '$.k') || ':' || event_type AS key,
arg_max(CAST(value AS VARCHAR), ts) AS value, MAX(ts) AS written_at, {NOW} + INTERVAL 7 DAY AS expires_at
FROM events WHERE ts >= {NOW} - INTERVAL 240 HOUR GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1"))
def materialize_online_pairs(t: Tables) -> DataFrame:
    return M.to_online(tall_pairs(t), "customer_product", 240, EVENTS_AS_OF)


def keyed_online(t: Tables) -> DataFrame:
    """Online rows by key string: good ones, keys of another shape, text that is not JSON, empty text."""
    bad = F.col("event_id") % 10
    key = (F.when(bad == 1, F.concat(F.lit("customer:"), F.col("user_id")))
           .when(bad == 2, F.concat(F.lit("customer:"), F.col("user_id"), F.lit(":x:"), F.col("event_type")))
           .when(bad == 3, F.concat(F.lit("product:"), F.col("user_id"), F.lit(":"), F.col("event_type")))
           .otherwise(F.concat(F.lit("customer:"), F.col("user_id"), F.lit(":"), F.col("event_type"))))
    value = (F.when(bad == 4, F.lit("{oops")).when(bad == 5, F.lit(""))
             .otherwise(F.col("value").cast("string")))
    return t.events().select(key.alias("key"), value.alias("value"), F.col("ts").alias("written_at"),
                             F.expr("ts + make_dt_interval(cast(event_id % 40 as int))").alias("expires_at"))


SQL_GOOD_ONLINE = f"""SELECT CAST(user_id AS VARCHAR) AS customer_id, event_type AS feature_name,
CAST(value AS VARCHAR) AS feature_value, ts AS "timestamp" FROM events WHERE event_id % 10 NOT IN (1, 2, 3, 4, 5)
AND ts + to_days(CAST(event_id % 40 AS INTEGER)) > {NOW}"""


@query(SQL_GOOD_ONLINE)
def materialize_offline(t: Tables) -> DataFrame:
    return M.from_online(keyed_online(t), "customer", as_of=EVENTS_AS_OF)


@query(f"""WITH base AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, event_type AS feature_name,
CAST(value + 1 AS VARCHAR) AS feature_value, ts AS "timestamp" FROM events WHERE event_type <> 'view'),
upd AS ({SQL_GOOD_ONLINE})
SELECT COALESCE(u.customer_id, b.customer_id) AS customer_id, COALESCE(u.feature_name, b.feature_name) AS feature_name,
COALESCE(u.feature_value, b.feature_value) AS feature_value, COALESCE(u."timestamp", b."timestamp") AS "timestamp"
FROM base b FULL JOIN upd u ON b.customer_id = u.customer_id AND b.feature_name = u.feature_name
AND b."timestamp" = u."timestamp\"""")
def offline_upsert(t: Tables) -> DataFrame:
    base = (t.tall_features().filter(F.col("feature_name") != "view")
            .withColumn("customer_id", F.col("customer_id").cast("string"))
            .withColumn("feature_value", (F.col("feature_value").cast("double") + 1).cast("string")))
    return M.to_offline(base, keyed_online(t), "customer", as_of=EVENTS_AS_OF)


@query(ORACLES["offline_upsert"])
def keyed_offline_upsert(t: Tables) -> DataFrame:
    """The same upsert as a write of a keyed table, which leaves the files of the base as they are."""
    base = (t.tall_features().filter(F.col("feature_name") != "view")
            .withColumn("customer_id", F.col("customer_id").cast("string"))
            .withColumn("feature_value", (F.col("feature_value").cast("double") + 1).cast("string")))
    table = KeyedTable.create(t.spark, scratch_dir(t.spark, "offline"), base.schema,
                              ["customer_id", "feature_name", "timestamp"], buckets=4)
    table.write(base)
    table.write(M.from_online(keyed_online(t), "customer", as_of=EVENTS_AS_OF))
    return table.scan()


@query(f"""WITH o AS (SELECT customer_id, feature_name, arg_max(feature_value, "timestamp") AS v, MAX("timestamp") AS seen_at
FROM {SQL_TALL} WHERE "timestamp" >= {NOW} - INTERVAL 48 HOUR AND feature_name IN ('view', 'click') GROUP BY 1, 2)
SELECT 'online' AS store, 'customer:' || customer_id || ':' || feature_name AS key, v AS value, seen_at AS written_at FROM o
UNION ALL SELECT 'offline', customer_id || ':' || feature_name, feature_value, "timestamp" FROM {SQL_TALL}""")
def materialize_both(t: Tables) -> DataFrame:
    empty = keyed_online(t).filter(F.lit(False))
    offline = t.tall_features().withColumn("customer_id", F.col("customer_id").cast("string"))
    on, off = M.run({"customer": offline}, empty, "both", ["customer"], 48, EVENTS_AS_OF,
                    {"customer": ["view", "click"]})
    rows = off["customer"].select(
        F.lit("offline").alias("store"), F.concat_ws(":", "customer_id", "feature_name").alias("key"),
        F.col("feature_value").alias("value"), F.col("timestamp").alias("written_at"))
    return on.select(F.lit("online").alias("store"), "key", "value", "written_at").unionByName(rows)


SQL_WIDE = f"""(SELECT CAST(c_custkey AS VARCHAR) AS entity_id,
  MAX(value) FILTER (feature_name = 'view') AS view, MAX(value) FILTER (feature_name = 'click') AS click,
  MAX(value) FILTER (feature_name = 'purchase') AS purchase
  FROM customer LEFT JOIN {SQL_LIVE} l ON CAST(c_custkey AS VARCHAR) = l.entity_id GROUP BY 1)"""


@query(f"""SELECT entity_id, CAST(view AS VARCHAR) AS view, CAST(click AS VARCHAR) AS click,
CAST(purchase AS VARCHAR) AS purchase FROM {SQL_WIDE}""")
def online_lookup(t: Tables) -> DataFrame:
    return S.read_online(keys(t), online(t), FEATURES[:3], "customer", EVENTS_AS_OF).drop("missing_features")


def _written(t: Tables):
    """The online rows in a keyed table after three writes, which meet keys in no order of time; every row
    stands again under another entity type."""
    table = S.online_table(t.spark, scratch_dir(t.spark, "online"), buckets=4)
    for i in range(3):
        some = online(t).where(F.pmod(F.xxhash64("entity_id", "written_at"), F.lit(3)) == i)
        table.write(some.unionByName(some.withColumn("entity_type", F.lit("product"))))
    return table


@query(f"""SELECT entity_id, feature_name, value, written_at FROM (SELECT *, row_number() OVER
  (PARTITION BY entity_id, feature_name ORDER BY written_at DESC, value DESC) AS n FROM {SQL_ONLINE})
  WHERE n = 1 AND (expires_at IS NULL OR expires_at > {NOW})""")
def keyed_online_scan(t: Tables) -> DataFrame:
    """All live values of one entity type, from its files alone."""
    found = S.live(_written(t).scan("customer"), EVENTS_AS_OF)
    return found.select("entity_id", "feature_name", F.col("value").cast("double").alias("value"), "written_at")


@query(f"""SELECT entity_id, CAST(view AS VARCHAR) AS view, CAST(click AS VARCHAR) AS click,
CAST(purchase AS VARCHAR) AS purchase FROM {SQL_WIDE}""")
def keyed_online_lookup(t: Tables) -> DataFrame:
    """All customers ask; buckets with many files were rewritten before."""
    table = _written(t)
    table.compact()
    return S.read_online_table(keys(t), table, FEATURES[:3], "customer", EVENTS_AS_OF).drop("missing_features")


@query(f"SELECT entity_id, view, click, purchase FROM {SQL_WIDE}")
def online_lookup_typed(t: Tables) -> DataFrame:
    types = {"view": "FLOAT", "click": "FLOAT", "purchase": "FLOAT"}
    return S.read_typed(keys(t), online(t), types, "customer", EVENTS_AS_OF).drop("missing_features")


@query(f"""SELECT entity_id, concat_ws(',', CASE WHEN view IS NULL THEN 'view' END,
CASE WHEN click IS NULL THEN 'click' END, CASE WHEN purchase IS NULL THEN 'purchase' END, 'absent') AS missing
FROM {SQL_WIDE}""")
def missing_features(t: Tables) -> DataFrame:
    got = S.read_online(keys(t), online(t), FEATURES, "customer", EVENTS_AS_OF)
    return got.select("entity_id", F.array_join("missing_features", ",").alias("missing"))


@query(f"""SELECT entity_id, view, click, COALESCE(view, -1) + COALESCE(click, -1) AS vector_sum FROM {SQL_WIDE}""")
def feature_vector(t: Tables) -> DataFrame:
    got = S.feature_vectors(keys(t), online(t), ["view", "click"], "customer", EVENTS_AS_OF)
    part = lambda i: F.coalesce(F.col("vector")[i], F.lit(-1.0))
    return got.select("entity_id", "view", "click", (part(0) + part(1)).alias("vector_sum"))


@query("""SELECT CAST(user_id AS VARCHAR) AS entity_id, 'product' AS entity_type, feature_name, value, is_null FROM (
SELECT user_id, 'value' AS feature_name, CAST(value AS VARCHAR) AS value, false AS is_null, event_id FROM events
UNION ALL SELECT user_id, 'kind', event_type, false, event_id FROM events
UNION ALL SELECT user_id, 'late', CASE WHEN value > 10 THEN 'true' ELSE 'null' END, value <= 10, event_id FROM events)""")
def query_to_online(t: Tables) -> DataFrame:
    register_views({"customer_events": t.events()})
    rows = S.materialize_query(t.spark, """SELECT user_id AS entity_id, 'product' AS entity_type, value,
        event_type AS kind, CASE WHEN value > 10 THEN true END AS late FROM customer_events""", as_of=EVENTS_AS_OF)
    return rows.select("entity_id", "entity_type", "feature_name", "value",
                       (F.col("value") == "null").alias("is_null"))


@query(f"""WITH l AS (SELECT * FROM (SELECT user_id, event_id, value, event_type, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1)
SELECT CAST(user_id AS VARCHAR) AS entity_id, 'amount' AS feature_name, CAST(value AS VARCHAR) AS value,
  {NOW} + INTERVAL 7 DAY AS expires_at FROM l WHERE event_id % 3 <> 0
UNION ALL SELECT CAST(user_id AS VARCHAR), 'kind', event_type, {NOW} + INTERVAL 7 DAY FROM l""")
def store_last_row(t: Tables) -> DataFrame:
    """Many rows of an id in one write: the last one is stored as a whole."""
    wide = t.events().select(F.col("user_id").alias("entity_id"), "ts", F.col("event_type").alias("kind"),
                             F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("amount"))
    rows = S.store_features_batch(wide, "user", EVENTS_AS_OF, order=["ts"])
    return rows.select("entity_id", "feature_name", "value", "expires_at")


def history(t: Tables) -> DataFrame:
    wide = t.events().select(F.col("user_id").alias("entity_id"), "event_type", "value",
                             F.get_json_object("props", "$.k").cast("int").alias("k"), "ts")
    return S.to_history(wide, "customer", features=["event_type", "value", "k"], timestamp="ts")


@query("""SELECT CAST(user_id AS VARCHAR) AS entity_id, "timestamp", event_type, value, k FROM (
SELECT user_id, ts AS "timestamp", event_type, value, json_extract_string(props, '$.k') AS k,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25') WHERE n <= 10""")
def feature_history_topn(t: Tables) -> DataFrame:
    got = S.read_history(history(t), ["event_type", "value", "k"], "customer",
                         start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", limit=10)
    return got.withColumn("value", F.col("value").cast("double"))


@query("""SELECT CAST(user_id AS VARCHAR) AS entity_id, ts AS "timestamp", event_type FROM events
WHERE user_id = 7 ORDER BY ts DESC LIMIT 100""")
def feature_history_entity(t: Tables) -> DataFrame:
    return S.read_history(history(t), ["event_type"], "customer", entity_id="7", limit=100)


@query("""SELECT 'online' AS store, CAST(user_id AS VARCHAR) AS entity_id, feature_name, value FROM (
SELECT user_id, 'amount' AS feature_name, CAST(value AS VARCHAR) AS value FROM events
UNION ALL SELECT user_id, 'kind', event_type FROM events)
UNION ALL SELECT 'history', CAST(user_id AS VARCHAR), event_type, CAST(value AS VARCHAR) FROM events""")
def dual_write(t: Tables) -> DataFrame:
    wide = t.events().select(F.col("user_id").alias("entity_id"), F.col("value").alias("amount"),
                             F.col("event_type").alias("kind"))
    on, past = S.write_both(wide, "customer", ttl_seconds=86_400, as_of=EVENTS_AS_OF)
    told = past.select("entity_id", F.from_json("data", "amount double, kind string").alias("d"))
    return on.select(F.lit("online").alias("store"), "entity_id", "feature_name", "value").unionByName(
        told.select(F.lit("history").alias("store"), "entity_id", F.col("d.kind").alias("feature_name"),
                    F.col("d.amount").cast("string").alias("value")))


SQL_PIT = """SELECT o.order_id, o.user_id, o.order_date, p.o_orderdate AS known_at, {amount} AS known_amount
FROM (SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_date FROM orders) o
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, MAX(CAST(o_totalprice AS DECIMAL(12,2))) AS amount FROM orders GROUP BY 1, 2) p
ON o.user_id = p.o_custkey AND o.order_date {op} p.o_orderdate"""


def _previous_order(t: Tables, strict: bool) -> DataFrame:
    left = t.orders().select("order_id", "user_id", "order_date")
    right = t.orders().select("user_id", F.col("order_date").alias("known_at"),
                              F.col("total_amount").alias("known_amount"))
    out = intervals.as_of_join(left, right, ["user_id"], "order_date", "known_at",
                               ["known_at", "known_amount"], strict, ["known_amount"])
    return out.withColumn("known_amount", F.col("known_amount").cast("double"))


@query(SQL_PIT.format(op=">", amount="CAST(p.amount AS DOUBLE)"))
def point_in_time_strict(t: Tables) -> DataFrame:
    return _previous_order(t, strict=True)


@query(SQL_PIT.format(op=">=", amount="CAST(p.amount AS DOUBLE)"))
def point_in_time(t: Tables) -> DataFrame:
    return _previous_order(t, strict=False)


@query("""SELECT l.event_id, l.entity_id, l.label_time, h.ts AS "timestamp", h.value, h.event_type
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS entity_id, ts AS label_time FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS entity_id, ts, value, event_type FROM events WHERE event_type <> 'purchase') h
ON l.entity_id = h.entity_id AND l.label_time >= h.ts""")
def training_set(t: Tables) -> DataFrame:
    events = t.events()
    labels = events.filter(F.col("event_type") == "purchase").select(
        "event_id", F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("label_time"))
    wide = events.filter(F.col("event_type") != "purchase").select(
        F.col("user_id").alias("entity_id"), "event_type", "value", "ts")
    past = S.to_history(wide, "customer", features=["event_type", "value"], timestamp="ts")
    return (S.point_in_time(labels, past, ["value", "event_type"], "customer")
            .withColumn("value", F.col("value").cast("double")))


@query(f"""SELECT entity_id, feature_name, value, written_at FROM (
SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY written_at DESC) AS n FROM {SQL_ONLINE})
WHERE n = 1 AND (expires_at IS NULL OR expires_at > {NOW})""")
def online_compaction(t: Tables) -> DataFrame:
    kept = maintain.compact(online(t), ["entity_type", "entity_id", "feature_name"],
                            ["written_at", "value"], EVENTS_AS_OF)
    return kept.select("entity_id", "feature_name", F.col("value").cast("double").alias("value"), "written_at")


@query(f"""SELECT o_orderkey AS order_id, o_orderstatus AS status, o_orderdate AS order_date FROM orders
WHERE o_orderdate > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 720 HOUR""")
def changed_orders(t: Tables) -> DataFrame:
    return latest.changed_since(t.orders(), "order_date", 720, ORDERS_AS_OF, strict=True).select(
        "order_id", "status", "order_date")
