"""Change data and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from featloom.catalog.base import EVENTS_AS_OF, SQL_LOG, Tables, query
from featloom.operators import intervals, keys as K
from featloom.plans import changes as C, maintain, star
from featloom.session import scratch_dir
from featloom.sinks.keyed import KeyedTable

ROW = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("amount", T.DoubleType()),
])


def _row(status, factor: int):
    return F.struct(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"),
        (F.col("o_totalprice") * factor).alias("amount"))


def _told(orders: DataFrame, parts: list, apart_ms: int) -> DataFrame:
    """The messages of each order, last ones first; the offset tells their place in the log.

    Record times are `apart_ms` milliseconds apart.
    """
    # texts are made of messages that are there, and of no others
    told = F.array(*[F.struct(F.when(there, value).alias("value"), F.lit(i).alias("place"), there.alias("there"))
                     for i, (there, value) in reversed(list(enumerate(parts)))])
    key = F.concat(F.lit('{"schema":{"type":"struct"},"payload":{"order_id":'), F.col("o_orderkey"), F.lit("}}"))
    # a topic has partitions, whatever the number of files of the table
    topic = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (orders.repartition(topic, "o_orderkey").select(key.alias("key"), F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("_at"), F.explode(F.filter(told, lambda m: m["there"])).alias("m"))
            .select("key", "m.value", F.lit("dbz.public.orders").alias("topic"),
                    (F.col("o_orderkey") * 10 + F.col("m.place")).alias("offset"),
                    F.timestamp_millis(F.col("_at") + F.col("m.place") * apart_ms).alias("timestamp")))


def _every(n: int):
    return F.col("o_orderkey") % n == 0


def messages(orders: DataFrame) -> DataFrame:
    """Change messages told by each order: created and updated (in one millisecond for every
    third), every 11th deleted, every 13th ended by a tombstone, every 26th created again;
    every 17th also has a text that cannot be read. Every other envelope stands bare."""
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    none = F.lit(None).cast(ROW)
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("COMPLETED")

    def change(before, after, op: str, when):
        body = F.struct(before.cast(ROW).alias("before"), after.cast(ROW).alias("after"), F.lit(op).alias("op"),
                        when.alias("ts_ms"))
        return F.when(_every(2), F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("payload"))))

    return _told(orders, [
        (F.lit(True), change(none, _row("PENDING", 1), "c", at)),
        (F.lit(True), change(_row("PENDING", 1), _row(status, 2), "u", at + F.when(_every(3), 0).otherwise(1000))),
        (_every(11), change(_row("COMPLETED", 2), none, "d", at + 2000)),
        (_every(13), F.lit(None).cast("string")),
        (_every(26), change(none, _row("AGAIN", 3), "c", at + 3000)),
        (_every(17), F.lit('{"payload": {"after": '))], 1000)


def base_table(t: Tables) -> DataFrame:
    """The table before the changes: the orders as first seen, and one old row per customer."""
    first = t.raw("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.lit("NEW").alias("status"), F.col("o_totalprice").alias("amount"))
    old = t.raw("customer").select(
        (-F.col("c_custkey") - 1).alias("order_id"), F.col("c_custkey").alias("user_id"),
        F.lit("OLD").alias("status"), F.col("c_acctbal").alias("amount"))
    return first.unionByName(old)


SQL_OLD = "SELECT -c_custkey - 1, c_custkey, 'OLD', c_acctbal FROM customer"
SQL_APPLIED = f"""SELECT o_orderkey AS order_id, o_custkey AS user_id,
CASE WHEN o_orderkey % 26 = 0 THEN 'AGAIN' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'COMPLETED' END AS status,
o_totalprice * CASE WHEN o_orderkey % 26 = 0 THEN 3 ELSE 2 END AS amount
FROM orders WHERE o_orderkey % 26 = 0 OR (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)
UNION ALL {SQL_OLD}"""


def _changes(t: Tables) -> DataFrame:
    return C.parse(messages(t.raw("orders")), ROW, ["order_id"])


@query(SQL_APPLIED)
def cdc_apply(t: Tables) -> DataFrame:
    return C.apply(base_table(t), C.flat(_changes(t), ROW), ["order_id"])


@query(f"""SELECT o_orderkey AS order_id, o_custkey AS user_id, 'NEW' AS status, o_totalprice AS amount FROM orders
WHERE o_orderkey % 13 <> 0 UNION ALL {SQL_OLD}""")
def cdc_tombstones(t: Tables) -> DataFrame:
    """Tombstones alone delete the rows that their keys name."""
    gone = _changes(t).filter("is_tombstone")
    return C.apply(base_table(t), C.flat(gone, ROW), ["order_id"])


@query("""SELECT 'orders' AS table_name, o_orderkey AS order_id, change FROM (
SELECT o_orderkey, 'created' AS change FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'updated' ELSE 'status_changed' END FROM orders
UNION ALL SELECT o_orderkey, 'deleted' FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, 'created' FROM orders WHERE o_orderkey % 26 = 0)""")
def cdc_status_changes(t: Tables) -> DataFrame:
    return C.classify_orders(_changes(t)).select(
        "table_name", F.coalesce("after.order_id", "before.order_id").alias("order_id"), "change")


def unwrapped_messages(orders: DataFrame) -> DataFrame:
    """Rows as the connector sends them unwrapped: inside `payload` (every other one bare), deletes
    only as tombstones (every 11th), every 22nd inserted again, every 17th with a text that cannot be read."""
    def row(status: str, factor: int):
        r = _row(status, factor)
        return F.when(_every(2), F.to_json(r)).otherwise(
            F.to_json(F.struct(F.struct(F.lit("struct").alias("type")).alias("schema"), r.alias("payload"))))
    return _told(orders, [(F.lit(True), row("FIRST", 1)), (F.lit(True), row("SECOND", 2)),
                          (_every(11), F.lit(None).cast("string")), (_every(22), row("AGAIN", 3)),
                          (_every(17), F.lit("oops"))], 0)


SQL_UNWRAPPED = f"""SELECT o_orderkey AS order_id, o_custkey AS user_id,
CASE WHEN o_orderkey % 22 = 0 THEN 'AGAIN' ELSE 'SECOND' END AS status,
o_totalprice * CASE WHEN o_orderkey % 22 = 0 THEN 3 ELSE 2 END AS amount
FROM orders WHERE o_orderkey % 22 = 0 OR o_orderkey % 11 <> 0 UNION ALL {SQL_OLD}"""


@query(SQL_UNWRAPPED)
def cdc_unwrapped(t: Tables) -> DataFrame:
    """Deletes by tombstone, and rows that come back after one."""
    changes = C.parse(unwrapped_messages(t.raw("orders")), ROW, ["order_id"], unwrapped=True)
    return C.apply(base_table(t), C.flat(changes, ROW), ["order_id"])


@query("""SELECT form, kind, COUNT(*) AS messages FROM (
SELECT 'envelope' AS form, unnest(['valid', 'valid', CASE WHEN o_orderkey % 11 = 0 THEN 'valid' END, CASE WHEN o_orderkey % 13 = 0
  THEN 'valid' END, CASE WHEN o_orderkey % 26 = 0 THEN 'valid' END, CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' END]) AS kind FROM orders
UNION ALL SELECT 'unwrapped', unnest(['valid', 'valid', CASE WHEN o_orderkey % 11 = 0 THEN 'valid' END,
  CASE WHEN o_orderkey % 22 = 0 THEN 'valid' END, CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' END]) FROM orders)
WHERE kind IS NOT NULL GROUP BY 1, 2""")
def cdc_rejects(t: Tables) -> DataFrame:
    """What could be read and what could not, together all messages; each message is parsed once."""
    parts = []
    for form, sent in (("envelope", messages(t.raw("orders"))), ("unwrapped", unwrapped_messages(t.raw("orders")))):
        judged = C.read(sent, ROW, ["order_id"], form == "unwrapped")
        parts.append(judged.select(F.lit(form).alias("form"), F.when(F.col("is_readable"), "valid").otherwise("rejected").alias("kind")))
    return parts[0].unionByName(parts[1]).groupBy("form", "kind").agg(F.count(F.lit(1)).alias("messages"))


# star schema -----------------------------------------------------------------
def user_members(t: Tables) -> DataFrame:
    return t.raw("customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("username"),
        (F.col("c_acctbal") > 0).alias("is_active"))


SQL_DIM_USER = """(SELECT row_number() OVER (ORDER BY substr(md5(CAST(c_custkey AS VARCHAR)), 1, 3),
  CAST(c_custkey AS VARCHAR)) AS user_key, CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username,
  c_acctbal > 0 AS is_active FROM customer)"""


@query(f"SELECT user_key, user_id, username, is_active, TIMESTAMP '{EVENTS_AS_OF}' AS created_at FROM {SQL_DIM_USER}")
def star_dimension(t: Tables) -> DataFrame:
    return star.load_dimension(user_members(t), "user_id", "user_key", EVENTS_AS_OF).drop("updated_at")


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY substr(md5(CAST(c_custkey AS VARCHAR)), 1, 3),
  CAST(c_custkey AS VARCHAR)) AS k FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT c_custkey, (SELECT MAX(k) FROM a) + row_number() OVER (ORDER BY substr(md5(CAST(c_custkey AS VARCHAR)), 1, 3),
  CAST(c_custkey AS VARCHAR)) AS k FROM customer WHERE c_custkey % 2 = 1)
SELECT k AS user_key, CAST(c_custkey AS VARCHAR) AS user_id FROM a UNION ALL SELECT k, CAST(c_custkey AS VARCHAR) FROM b""")
def star_dimension_extended(t: Tables) -> DataFrame:
    all_members = user_members(t)
    even = star.load_dimension(all_members.filter(F.col("user_id").cast("bigint") % 2 == 0), "user_id", "user_key",
                               EVENTS_AS_OF)
    return star.load_dimension(all_members, "user_id", "user_key", EVENTS_AS_OF, even).select("user_key", "user_id")


def feature_members(t: Tables) -> DataFrame:
    """The features seen in the events: one per event type."""
    kind = F.when(F.col("feature_id") == "signup", "TEXT").otherwise("FLOAT")
    return (t.events().select(F.col("event_type").alias("feature_id")).distinct().withColumn("data_type", kind))


SQL_DIM_FEATURE = """(SELECT row_number() OVER (ORDER BY substr(md5(feature_id), 1, 3), feature_id) AS feature_key,
  feature_id, CASE WHEN feature_id = 'signup' THEN 'TEXT' ELSE 'FLOAT' END AS data_type
  FROM (SELECT DISTINCT event_type AS feature_id FROM events))"""


@query(f"""SELECT feature_key, entity_id, CASE WHEN data_type = 'FLOAT' THEN value END AS value_numeric,
CASE WHEN data_type = 'TEXT' THEN CAST(value AS VARCHAR) END AS value_text, ts AS valid_from,
lead(ts) OVER (PARTITION BY feature_key, entity_id ORDER BY ts) AS valid_to
FROM (SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type, value, ts FROM events)
JOIN {SQL_DIM_FEATURE} ON event_type = feature_id""")
def star_feature_values(t: Tables) -> DataFrame:
    features = star.load_dimension(feature_members(t), "feature_id", "feature_key", EVENTS_AS_OF)
    tall = t.events().select(F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("feature_id"),
                             F.col("value").cast("string").alias("value"), F.col("ts").alias("valid_from"))
    return star.load_feature_values(tall, features, EVENTS_AS_OF)[0].select(
        "feature_key", "entity_id", "value_numeric", "value_text", "valid_from", "valid_to")


@query("""SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)
AS valid_to FROM events""")
def scd_intervals(t: Tables) -> DataFrame:
    rows = t.events().select("user_id", "event_type", F.col("ts").alias("valid_from"))
    return star.validity_intervals(rows, "user_id", "event_type")


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts) AS valid_from, value FROM events),
d AS (SELECT user_id, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from) AS next FROM (SELECT DISTINCT user_id, valid_from FROM e)),
n AS (SELECT e.*, next, row_number() OVER (PARTITION BY e.user_id, e.valid_from ORDER BY value DESC) AS r
  FROM e JOIN d ON e.user_id = d.user_id AND e.valid_from = d.valid_from)
SELECT user_id, valid_from, value, CASE WHEN r = 1 THEN next ELSE valid_from END AS valid_to FROM n""")
def scd_equal_starts(t: Tables) -> DataFrame:
    """Many values that start together, equal ones among them: one of them lasts."""
    rows = t.events().select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("valid_from"), "value")
    return intervals.with_next(rows, ["user_id"], "valid_from")


@query("""SELECT event_id, CASE WHEN m = 0 THEN value END AS value_numeric,
CASE WHEN m = 1 THEN event_type END AS value_text, CASE WHEN m = 2 THEN ts END AS value_timestamp,
CASE WHEN m = 3 THEN value > 10 END AS value_boolean FROM (SELECT *, event_id % 4 AS m FROM events)""")
def typed_eav(t: Tables) -> DataFrame:
    m = F.col("event_id") % 4
    rows = t.events().select(
        "event_id",
        F.when(m == 0, "FLOAT").when(m == 1, "STRING").when(m == 2, "TIMESTAMP").otherwise("BOOL").alias("data_type"),
        F.when(m == 0, F.col("value").cast("string")).when(m == 1, F.col("event_type"))
        .when(m == 2, F.col("ts").cast("string")).otherwise((F.col("value") > 10).cast("string")).alias("value"))
    return star.typed_values(rows).drop("data_type", "value")


@query("""WITH h AS (SELECT o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, o_orderkey FROM orders)
SELECT c_custkey AS customer_id, o_orderkey AS order_id, valid_from, valid_to FROM customer
JOIN h ON c_custkey = o_custkey
WHERE valid_from <= TIMESTAMP '2000-01-01' AND (valid_to IS NULL OR TIMESTAMP '2000-01-01' < valid_to)""")
def valid_at_lookup(t: Tables) -> DataFrame:
    orders = t.raw("orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"),
                                    F.col("o_orderdate").alias("valid_from"))
    facts = intervals.with_next(orders, ["customer_id"], "valid_from", tiebreak=["order_id"])
    asked = t.raw("customer").select(F.col("c_custkey").alias("customer_id"),
                                     F.lit("2000-01-01").cast("timestamp_ntz").alias("at"))
    return intervals.valid_at(facts, asked, ["customer_id"], "at").drop("at")


SQL_DIM_MODEL = f"""(SELECT row_number() OVER (ORDER BY substr(md5(model_id), 1, 3), model_id) AS model_key, model_id
  FROM (SELECT DISTINCT model_name || ':' || model_version AS model_id FROM {SQL_LOG}))"""


def _models(t: Tables) -> DataFrame:
    ids = t.prediction_log().select(F.concat_ws(":", "model_name", "model_version").alias("model_id")).distinct()
    return star.load_dimension(ids, "model_id", "model_key", EVENTS_AS_OF)


@query(f"""SELECT model_key, request_id AS entity_id, prediction AS prediction_value,
CASE WHEN prediction > 10 THEN 'high' ELSE 'low' END AS prediction_label, ts AS prediction_timestamp
FROM {SQL_LOG} l JOIN {SQL_DIM_MODEL} m ON l.model_name || ':' || l.model_version = m.model_id""")
def star_predictions(t: Tables) -> DataFrame:
    facts = t.prediction_log().select(
        F.concat_ws(":", "model_name", "model_version").alias("model_id"), F.col("request_id").alias("entity_id"),
        F.col("prediction").alias("prediction_value"),
        F.when(F.col("prediction") > 10, "high").otherwise("low").alias("prediction_label"),
        F.col("ts").alias("prediction_timestamp"), "latency_ms")
    return star.load_predictions(facts, _models(t))[0].drop("latency_ms")


@query(f"""SELECT model_key, CASE WHEN l.model_version = 'v0' THEN NULL ELSE e.experiment_key END AS experiment_key,
'latency_ms' AS metric_name, l.latency_ms AS metric_value, ts AS metric_timestamp
FROM {SQL_LOG} l JOIN {SQL_DIM_MODEL} m ON l.model_name || ':' || l.model_version = m.model_id
LEFT JOIN (SELECT row_number() OVER (ORDER BY substr(md5(experiment_id), 1, 3), experiment_id) AS experiment_key, experiment_id
  FROM (SELECT DISTINCT job AS experiment_id FROM {SQL_LOG})) e ON l.job = e.experiment_id""")
def star_model_metrics(t: Tables) -> DataFrame:
    log = t.prediction_log()
    experiments = star.load_dimension(log.select(F.col("job").alias("experiment_id")).distinct(), "experiment_id",
                                      "experiment_key", EVENTS_AS_OF)
    metrics = log.select(
        F.concat_ws(":", "model_name", "model_version").alias("model_id"),
        F.when(F.col("model_version") != "v0", F.col("job")).alias("experiment_id"),
        F.lit("latency_ms").alias("metric_name"), F.col("latency_ms").alias("metric_value"),
        F.col("ts").alias("metric_timestamp"))
    return star.load_model_metrics(metrics, _models(t), experiments)[0]


@query(f"""SELECT 'fact' AS kind, COUNT(*) AS n FROM {SQL_LOG} WHERE model_version <> 'v1'
UNION ALL SELECT 'unknown', COUNT(*) FROM {SQL_LOG} WHERE model_version = 'v1'""")
def star_unknown_models(t: Tables) -> DataFrame:
    """Predictions of models that the dimension lacks stand beside the facts."""
    facts = t.prediction_log().select(F.concat_ws(":", "model_name", "model_version").alias("model_id"),
                                      F.col("request_id").alias("entity_id"), "latency_ms")
    some = _models(t).filter(~F.col("model_id").endswith(":v1"))
    found, missing = star.load_predictions(facts, some)
    return (found.agg(F.lit("fact").alias("kind"), F.count(F.lit(1)).alias("n"))
            .unionByName(missing.agg(F.lit("unknown").alias("kind"), F.count(F.lit(1)).alias("n"))))


@query(f"""SELECT event_id, l.entity_id FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS entity_id FROM events) l
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE CAST(c_custkey AS VARCHAR) = l.entity_id AND c_acctbal > 0)""")
def unknown_members(t: Tables) -> DataFrame:
    active = t.raw("customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").cast("string").alias("entity_id"))
    facts = t.events().select("event_id", F.col("user_id").cast("string").alias("entity_id"))
    return K.unknown(facts, active, "entity_id").select("event_id", "entity_id")


@query("""SELECT 'feature' AS kind, event_id FROM events WHERE ts >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY
UNION ALL SELECT 'prediction', event_id FROM events WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY""")
def retention_facts(t: Tables) -> DataFrame:
    rows = t.events().select("event_id", F.col("ts").alias("created_at"))
    kept = maintain.retain_feature_values(rows, "2024-04-10 00:00:00").select(F.lit("feature").alias("kind"), "event_id")
    return kept.unionByName(maintain.retain_predictions(rows, "2024-02-10 00:00:00")
                            .select(F.lit("prediction").alias("kind"), "event_id"))


@query("SELECT event_id, ts AS created_at FROM events WHERE ts >= TIMESTAMP '2024-01-31 09:30:00' - INTERVAL 15 DAY")
def retention_partitions(t: Tables) -> DataFrame:
    """Events in a table laid out by day: expired days leave unread, the day of the cut is rewritten."""
    rows = t.events().select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.col("ts").alias("created_at"))
    table = KeyedTable.create(t.spark, scratch_dir(t.spark, "retention"), rows.schema, ["day", "event_id"], buckets=1, leading="day")
    table.write(rows)
    maintain.retire(table, "created_at", 15, "2024-01-31 09:30:00")
    return table.scan().drop("day")
