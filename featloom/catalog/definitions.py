"""Features from declarative definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.catalog.base import EVENTS_AS_OF, ORDERS_AS_OF, Tables, query
from featloom.functions.keys import ENTITY_IDS
from featloom.plans import definitions as D, golden, registry as R

SQL_EVENTS = """(SELECT user_id AS customer_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
  event_type, ts AS event_timestamp FROM events)"""
CART = "click"  # stands in for the cart event, which the test events lack


@query(f"""SELECT customer_id,
 date_diff('day', MAX(event_timestamp), TIMESTAMP '{EVENTS_AS_OF}') AS customer_days_since_last_active,
 COUNT(*) AS customer_event_count, COUNT(DISTINCT CAST(event_timestamp AS DATE)) AS customer_active_days,
 CAST(COUNT(*) FILTER (event_type = 'purchase') AS DOUBLE)
   / COUNT(DISTINCT CAST(event_timestamp AS DATE)) AS customer_purchase_frequency
FROM {SQL_EVENTS} GROUP BY customer_id""")
def defs_customer(t: Tables) -> DataFrame:
    return D.compute(t.customer_events(), D.CUSTOMER_EVENT_FEATURES, ["customer_id"], EVENTS_AS_OF)


@query(f"""SELECT product_id, COUNT(*) FILTER (event_type = 'view') AS product_view_count,
 COUNT(*) FILTER (event_type = 'purchase') AS product_purchase_count,
 COUNT(*) FILTER (event_type = '{CART}') AS product_cart_count,
 CAST(COUNT(*) FILTER (event_type = 'purchase') AS DOUBLE)
   / NULLIF(COUNT(*) FILTER (event_type = 'view'), 0) AS product_conversion_rate
FROM {SQL_EVENTS} GROUP BY product_id""")
def defs_product(t: Tables) -> DataFrame:
    return D.compute(t.customer_events(), D.product_event_features(CART), ["product_id"], EVENTS_AS_OF)


@query(f"""SELECT customer_id, product_id, COUNT(*) AS customer_product_interaction_count,
 COUNT(*) FILTER (event_type = 'view') AS customer_product_view_count,
 COUNT(*) FILTER (event_type = '{CART}') AS customer_product_cart_count,
 COUNT(*) FILTER (event_type = 'purchase') AS customer_product_purchase_count
FROM {SQL_EVENTS} GROUP BY customer_id, product_id""")
def defs_customer_product(t: Tables) -> DataFrame:
    return D.compute(t.customer_events(), D.customer_product_event_features(CART),
                     ["customer_id", "product_id"], EVENTS_AS_OF)


@query(f"""SELECT o_custkey AS customer_id,
 CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY) AS DOUBLE)
   AS customer_total_purchases_30d,
 date_diff('day', MAX(o_orderdate), TIMESTAMP '{ORDERS_AS_OF}') AS customer_days_since_last_purchase
FROM orders GROUP BY 1""")
def defs_customer_purchases(t: Tables) -> DataFrame:
    rows = t.purchases().select("customer_id", F.col("amount").alias("purchase_amount"),
                                F.col("created_at").alias("purchase_date"))
    return D.compute(rows, D.CUSTOMER_PURCHASE_FEATURES, ["customer_id"], ORDERS_AS_OF)


@query(f"""SELECT l_partkey AS product_id,
 COUNT(l_orderkey) FILTER (o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY) AS product_purchase_count_30d
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def defs_product_purchases(t: Tables) -> DataFrame:
    dates = t.purchases().select("purchase_id", F.col("created_at").alias("purchase_date"))
    rows = t.purchase_items().join(dates, "purchase_id")
    return D.compute(rows, D.PRODUCT_PURCHASE_FEATURES, ["product_id"], ORDERS_AS_OF)


@query(f"""SELECT o_custkey AS customer_id,
 date_diff('day', MAX(o_orderdate) FILTER (o_orderstatus = 'F'), TIMESTAMP '{ORDERS_AS_OF}') AS days_since_last_finished,
 COUNT(*) FILTER (o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY) AS orders_30d
FROM orders GROUP BY 1""")
def defs_filtered_dates(t: Tables) -> DataFrame:
    """A date difference with a source filter, and the evaluation time given as a column."""
    wanted = [
        D.Definition("days_since_last_finished", "customer", "INT",
                     ({"type": "date_diff", "from": "NOW()", "to": "MAX(o_orderdate)"},),
                     {"table": "orders", "filter": "o_orderstatus = 'F'"}),
        D.Definition("orders_30d", "customer", "INT", ({"type": "count", "field": "*"},),
                     {"table": "orders", "filter": "o_orderdate >= NOW() - INTERVAL '30 days'"})]
    rows = t.raw("orders").withColumnRenamed("o_custkey", "customer_id")
    return D.compute(rows, wanted, ["customer_id"], F.lit(ORDERS_AS_OF).cast("timestamp_ntz")).withColumn(
        "days_since_last_finished", F.col("days_since_last_finished").cast("bigint"))


@query(f"""WITH e AS {SQL_EVENTS},
c AS (SELECT customer_id, COUNT(*) AS n, COUNT(DISTINCT CAST(event_timestamp AS DATE)) AS d,
  date_diff('day', MAX(event_timestamp), TIMESTAMP '{EVENTS_AS_OF}') AS since,
  CAST(COUNT(*) FILTER (event_type = 'purchase') AS DOUBLE) / COUNT(DISTINCT CAST(event_timestamp AS DATE)) AS f FROM e GROUP BY 1),
p AS (SELECT COUNT(*) FILTER (event_type = 'view') AS v, COUNT(*) FILTER (event_type = 'purchase') AS b,
  COUNT(*) FILTER (event_type = '{CART}') AS k,
  CAST(COUNT(*) FILTER (event_type = 'purchase') AS DOUBLE) / NULLIF(COUNT(*) FILTER (event_type = 'view'), 0) AS r FROM e GROUP BY product_id),
x AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (event_type = 'view') AS v, COUNT(*) FILTER (event_type = '{CART}') AS k,
  COUNT(*) FILTER (event_type = 'purchase') AS b FROM e GROUP BY customer_id, product_id),
f AS (SELECT unnest(['customer_days_since_last_active', 'customer_event_count', 'customer_active_days']) AS name,
  unnest([(SELECT SUM(since) FROM c), (SELECT SUM(n) FROM c), (SELECT SUM(d) FROM c)]) AS total
  UNION ALL SELECT unnest(['product_view_count', 'product_purchase_count', 'product_cart_count']),
  unnest([(SELECT SUM(v) FROM p), (SELECT SUM(b) FROM p), (SELECT SUM(k) FROM p)])
  UNION ALL SELECT unnest(['customer_product_interaction_count', 'customer_product_view_count', 'customer_product_cart_count',
  'customer_product_purchase_count']), unnest([(SELECT SUM(n) FROM x), (SELECT SUM(v) FROM x), (SELECT SUM(k) FROM x), (SELECT SUM(b) FROM x)])
  UNION ALL SELECT 'customer_purchase_frequency', CAST(SUM(CAST(floor(f * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 FROM c
  UNION ALL SELECT 'product_conversion_rate', CAST(SUM(CAST(floor(r * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 FROM p)
SELECT g.name AS group_name, g.entity_type, m.name, m.kind AS value_type,
  m.category, CAST(f.total AS DOUBLE) AS total FROM (VALUES
  ('customer_engagement_features', 'customer'), ('product_popularity_features', 'product'),
  ('customer_product_interaction_features', 'customer_product'), ('conversion_features', 'mixed')) g(name, entity_type)
JOIN (VALUES ('customer_engagement_features', 'customer_days_since_last_active', 'INTEGER', 'BEHAVIORAL'),
 ('customer_engagement_features', 'customer_event_count', 'INTEGER', 'BEHAVIORAL'),
 ('customer_engagement_features', 'customer_active_days', 'INTEGER', 'BEHAVIORAL'),
 ('product_popularity_features', 'product_view_count', 'INTEGER', 'POPULARITY'),
 ('product_popularity_features', 'product_purchase_count', 'INTEGER', 'POPULARITY'),
 ('product_popularity_features', 'product_cart_count', 'INTEGER', 'POPULARITY'),
 ('customer_product_interaction_features', 'customer_product_interaction_count', 'INTEGER', 'INTERACTION'),
 ('customer_product_interaction_features', 'customer_product_view_count', 'INTEGER', 'INTERACTION'),
 ('customer_product_interaction_features', 'customer_product_cart_count', 'INTEGER', 'INTERACTION'),
 ('customer_product_interaction_features', 'customer_product_purchase_count', 'INTEGER', 'INTERACTION'),
 ('conversion_features', 'customer_purchase_frequency', 'FLOAT', 'BEHAVIORAL'),
 ('conversion_features', 'product_conversion_rate', 'FLOAT', 'CONVERSION'),
 ('conversion_features', 'customer_product_cart_count', 'INTEGER', 'INTERACTION'),
 ('conversion_features', 'customer_product_purchase_count', 'INTEGER', 'INTERACTION')) m(group_name, name, kind, category)
ON g.name = m.group_name LEFT JOIN f ON m.name = f.name""")
def golden_set(t: Tables) -> DataFrame:
    """The sample definitions registered, their groups checked and read back, and all features computed, of all
    entity types by one read of the events."""
    spark = t.spark
    registry = R.register(golden.definition_rows(spark), golden.empty_registry(spark), EVENTS_AS_OF)
    groups = R.register_groups(golden.group_rows(spark), registry, golden.empty_groups(spark), EVENTS_AS_OF)
    members = (R.list_groups(groups, owner=golden.TEAM).select(F.col("name").alias("group_name"), "entity_type", F.explode("feature_names").alias("name"))
               .join(registry.select("name", "value_type", "category"), "name"))
    grains = [(ids, D.of_registry(golden.DEFINITIONS, kind, CART)) for kind, ids in ENTITY_IDS.items()]
    totals = None
    for (ids, _), wide in zip(grains, D.compute_grains(t.customer_events(), grains, EVENTS_AS_OF)):
        features = [c for c in wide.columns if c not in ids]
        # ratios are added in billionths, so that their order does not matter
        billionths = {c: wide.schema[c].dataType.simpleString() == "double" for c in features}
        sums = wide.agg(*[(F.sum(F.floor(F.col(c) * 1e9)).cast("double") / 1e9 if billionths[c] else F.sum(c).cast("double")).alias(c)
                          for c in features])
        tall = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("total")) for c in features])))
        totals = tall if totals is None else totals.unionByName(tall)
    return members.join(totals, "name", "left").select("group_name", "entity_type", "name", "value_type", "category", "total")
