"""Purchase features, user vectors and documents."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from featloom.catalog.base import (
    ORDERS_AS_OF, SQL_CUSTOMERS, SQL_ITEMS, SQL_PRODUCTS, SQL_PURCHASES, Tables, query,
)
from featloom.operators import latest
from featloom.plans import batch_features, documents, feature_store, rolling
from featloom.session import scratch_dir

CATEGORIES = {"ECONOMY": "economy_purchases", "SMALL": "small_purchases"}
NOW = f"TIMESTAMP '{ORDERS_AS_OF}'"


def _days(x: str) -> str:
    return f"CAST(date_diff('day', {x}, {NOW}) AS INTEGER)"


def _customer_sql(join: str, where: str) -> str:
    return f"""
WITH p AS (SELECT c.customer_id, c.created_at AS customer_created_at, p.purchase_id, p.amount,
                  p.created_at AS purchase_date
           FROM {SQL_CUSTOMERS} c LEFT JOIN {SQL_PURCHASES} p ON c.customer_id = p.customer_id {join} {where})
SELECT customer_id, 'customer' AS entity_type, COUNT(purchase_id) AS customer_purchase_count_30d,
       CAST(SUM(amount) AS DOUBLE) AS customer_total_purchases_30d,
       CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS customer_avg_purchase_30d,
       {_days('MAX(purchase_date)')} AS customer_days_since_last_purchase,
       {_days('MIN(customer_created_at)')} AS customer_account_age_days
FROM p GROUP BY customer_id"""


SINCE_30 = f"created_at >= {NOW} - INTERVAL 30 DAY"


@query(_customer_sql("", f"WHERE p.{SINCE_30} OR p.created_at IS NULL"))
def customer_features_30d(t: Tables) -> DataFrame:
    return batch_features.customer_features(t.customers(), t.purchases(), ORDERS_AS_OF, 30)


@query(_customer_sql(f"AND p.{SINCE_30}", ""))
def customer_features_keep_inactive(t: Tables) -> DataFrame:
    return batch_features.customer_features(t.customers(), t.purchases(), ORDERS_AS_OF, 30, keep_inactive=True)


LAST_DAYS = [f"2001-{d}" for d in ("07-31", "08-01", "08-02")]


@query(" UNION ALL ".join(
    f"SELECT '{day}' AS as_of, * FROM (" + _customer_sql(f"AND p.created_at < {NOW}", f"WHERE p.{SINCE_30} OR p.created_at IS NULL")
    .replace(ORDERS_AS_OF, f"{day} 00:00:00") + ")" for day in LAST_DAYS))
def rolling_customer_features(t: Tables) -> DataFrame:
    """Features as of three days in a row, each from the day before and one day of purchases."""
    ends = [dt.date.fromisoformat(day) for day in LAST_DAYS]
    state = rolling.RollingCustomers.start(t.purchases(), scratch_dir(t.spark, "rolling"), ends[0] - dt.timedelta(2), buckets=4)
    out = []
    for end in ends:
        day = end - dt.timedelta(1)
        state.advance(t.purchases().where(F.to_date("created_at") == F.lit(day)), day)
        out.append(state.features(t.customers()).select(F.lit(end.isoformat()).alias("as_of"), "*"))
    return reduce(DataFrame.unionByName, out)


def _product_sql(items: str, where: str) -> str:
    return f"""
WITH p AS (SELECT p.product_id, p.price, p.created_at AS product_created_at, i.purchase_id, i.quantity,
                  i.purchase_date
           FROM {SQL_PRODUCTS} p LEFT JOIN {items} i ON p.product_id = i.product_id {where})
SELECT product_id, 'product' AS entity_type, COUNT(purchase_id) AS product_purchase_count_30d,
       CAST(SUM(quantity) AS BIGINT) AS product_quantity_sold_30d,
       CAST(SUM(quantity * price) AS DOUBLE) AS product_revenue_30d,
       {_days('MAX(purchase_date)')} AS product_days_since_last_purchase,
       {_days('MIN(product_created_at)')} AS product_age_days
FROM p GROUP BY product_id"""


def _dated(join: str) -> str:
    return f"""(SELECT i.*, u.created_at AS purchase_date FROM {SQL_ITEMS} i {join} u
               ON i.purchase_id = u.purchase_id)"""


@query(_product_sql(_dated(f"LEFT JOIN {SQL_PURCHASES}"),
                    f"WHERE i.purchase_date >= {NOW} - INTERVAL 30 DAY OR i.purchase_date IS NULL"))
def product_features_30d(t: Tables) -> DataFrame:
    return batch_features.product_features(t.products(), t.purchase_items(), t.purchases(), ORDERS_AS_OF, 30)


@query(_product_sql(_dated(f"JOIN (SELECT * FROM {SQL_PURCHASES} WHERE {SINCE_30})"), ""))
def product_features_keep_inactive(t: Tables) -> DataFrame:
    return batch_features.product_features(t.products(), t.purchase_items(), t.purchases(), ORDERS_AS_OF, 30,
                                           keep_inactive=True)


@query(f"""
SELECT c.customer_id || ':' || p.product_id AS entity_id, 'customer_product' AS entity_type,
       COUNT(i.purchase_id) AS customer_product_purchase_count_90d,
       CAST(SUM(i.quantity) AS BIGINT) AS customer_product_quantity_90d,
       {_days('MAX(u.created_at)')} AS customer_product_days_since_last_purchase
FROM {SQL_CUSTOMERS} c JOIN {SQL_PURCHASES} u ON c.customer_id = u.customer_id
JOIN {SQL_ITEMS} i ON u.purchase_id = i.purchase_id JOIN {SQL_PRODUCTS} p ON i.product_id = p.product_id
WHERE u.created_at >= {NOW} - INTERVAL 90 DAY GROUP BY c.customer_id, p.product_id""")
def customer_product_features_90d(t: Tables) -> DataFrame:
    return batch_features.customer_product_features(
        t.customers(), t.products(), t.purchases(), t.purchase_items(), ORDERS_AS_OF, 90)


SQL_VECTOR = f"""
WITH s AS (SELECT c.customer_id AS user_id, COUNT(o.purchase_id) AS order_count,
                  COALESCE(CAST(SUM(o.amount) AS DOUBLE), 0) AS total_spent,
                  COALESCE(CAST(SUM(o.amount) AS DOUBLE) / COUNT(o.amount), 0) AS avg_order_value,
                  COALESCE(MAX(o.created_at), MIN(c.created_at)) AS last_order
           FROM {SQL_CUSTOMERS} c LEFT JOIN {SQL_PURCHASES} o ON c.customer_id = o.customer_id GROUP BY 1),
     k AS (SELECT o_custkey AS user_id, COUNT(*) FILTER (p_type = 'ECONOMY') AS e,
                  COUNT(*) FILTER (p_type = 'SMALL') AS m
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT s.user_id, order_count, total_spent, avg_order_value,
       (epoch_us({NOW}) - epoch_us(last_order)) / 86400e6 AS days_since_last_order,
       COALESCE(e, 0) AS economy_purchases, COALESCE(m, 0) AS small_purchases
FROM s LEFT JOIN k ON s.user_id = k.user_id"""


def _vectors(t: Tables) -> DataFrame:
    return batch_features.user_vectors(t.users(), t.orders(), t.order_items(), t.store_products(),
                                       CATEGORIES, ORDERS_AS_OF)


@query(SQL_VECTOR)
def user_feature_vector(t: Tables) -> DataFrame:
    return _vectors(t)


EXPIRY = f"{NOW} + INTERVAL 1 DAY"


@query(f"""SELECT 'user_features:' || user_id AS doc_key, {EXPIRY} AS expires_at, order_count, total_spent,
avg_order_value, days_since_last_order, economy_purchases, small_purchases FROM ({SQL_VECTOR})""")
def user_vector_documents(t: Tables) -> DataFrame:
    docs = documents.user_vector_documents(_vectors(t), ORDERS_AS_OF)
    body = F.from_json("doc", "order_count bigint, total_spent double, avg_order_value double, "
                              "days_since_last_order double, economy_purchases bigint, small_purchases bigint")
    return docs.select("doc_key", "expires_at", body.alias("d")).select("doc_key", "expires_at", "d.*")


SQL_USERS = """(SELECT c_custkey AS user_id, c_name AS username, lower(c_name) || '@example.com' AS email,
  TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
  TIMESTAMP '2001-07-31 12:00:00' + to_hours(CAST(c_custkey % 48 AS INTEGER)) AS updated_at,
  CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2001-07-01' + to_hours(CAST(c_custkey % 48 AS INTEGER)) END
    AS last_login FROM customer)"""
ISO = "'%Y-%m-%dT%H:%M:%S'"
# half of the orders have microseconds
TOUCHED = ("(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + "
           "to_microseconds(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 1000000 END))")


def _iso(x: str) -> str:
    return f"regexp_replace(strftime({x}, '%Y-%m-%dT%H:%M:%S.%f'), '[.]000000$', '')"


@query(f"""SELECT 'user:' || user_id AS doc_key, {EXPIRY} AS expires_at, username, email,
strftime(created_at, {ISO}) AS created_at, strftime(updated_at, {ISO}) AS updated_at,
strftime(last_login, {ISO}) AS last_login
FROM {SQL_USERS} WHERE updated_at > {NOW} - INTERVAL 1 DAY""")
def user_documents(t: Tables) -> DataFrame:
    docs = documents.user_documents(t.users(), ORDERS_AS_OF)
    body = F.from_json("doc", "username string, email string, created_at string, updated_at string, last_login string")
    return docs.select("doc_key", "expires_at", body.alias("d")).select("doc_key", "expires_at", "d.*")


@query(f"""SELECT 'product:' || p_partkey AS doc_key, {EXPIRY} AS expires_at, p_name AS name,
CAST(NULL AS VARCHAR) AS description, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
CAST(p_size AS INTEGER) AS inventory, p_type AS category,
strftime(TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)), {ISO}) AS created_at,
strftime(TIMESTAMP '2001-07-31 12:00:00' + to_hours(CAST(p_partkey % 48 AS INTEGER)), {ISO}) AS updated_at
FROM part WHERE TIMESTAMP '2001-07-31 12:00:00' + to_hours(CAST(p_partkey % 48 AS INTEGER)) > {NOW} - INTERVAL 1 DAY""")
def product_documents(t: Tables) -> DataFrame:
    docs = documents.product_documents(t.store_products(), ORDERS_AS_OF)
    body = F.from_json("doc", "name string, description string, price double, inventory int, "
                              "category string, created_at string, updated_at string")
    return docs.select("doc_key", "expires_at", body.alias("d")).select("doc_key", "expires_at", "d.*")


SQL_LINES = """string_agg({product} || 'x' || CAST(l_quantity AS INTEGER) || '@' ||
  CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) * 100 AS BIGINT), ';'
  ORDER BY {product}, CAST(l_quantity AS INTEGER), l_extendedprice)"""


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, {TOUCHED} AS touched, COUNT(*) AS n,
  {SQL_LINES.format(product="l_partkey")} AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE {TOUCHED} > {NOW} - INTERVAL 30 DAY GROUP BY ALL)
SELECT 'order:' || o_orderkey AS doc_key, {EXPIRY} AS expires_at, o_custkey AS user_id, o_orderstatus AS status,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_amount, {_iso("o_orderdate")} AS order_date,
  {_iso("o_orderdate")} AS created_at, {_iso("touched")} AS updated_at, n AS item_count, 1 AS parts,
  NULL AS order_id, NULL AS part, NULL AS items FROM o
UNION ALL SELECT 'order:' || o_orderkey || ':items:0', {EXPIRY}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  o_orderkey, 0, items FROM o""")
def order_documents(t: Tables) -> DataFrame:
    docs = documents.order_documents(t.orders(), t.order_items(), ORDERS_AS_OF, hours=30 * 24)
    body = F.from_json("doc", "user_id bigint, status string, total_amount double, order_date string, created_at string, "
                              "updated_at string, item_count bigint, parts int, order_id bigint, part int, "
                              "items array<struct<product_id:bigint,quantity:int,price:double>>")
    line = lambda i: F.concat_ws("", i["product_id"], F.lit("x"), i["quantity"], F.lit("@"),
                                 F.round(i["price"] * 100).cast("bigint"))
    d = docs.select("doc_key", "expires_at", body.alias("d")).select("doc_key", "expires_at", "d.*")
    return d.withColumn("items", F.array_join(F.transform("items", line), ";"))


@query(f"""SELECT 'order:' || p_partkey AS doc_key, COUNT(*) AS item_count, CAST(ceil(COUNT(*) / 10.0) AS INTEGER) AS parts,
CAST(SUM(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity, COUNT(*) AS told
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""")
def large_order_documents(t: Tables) -> DataFrame:
    """Parts as orders of many lines, in pages of about ten, read back from a store with one row for each key."""
    orders = t.raw("part").select(
        F.col("p_partkey").alias("order_id"), F.lit(0).alias("user_id"), F.lit("F").alias("status"),
        F.lit(0).cast("decimal(12,2)").alias("total_amount"),
        *[F.lit(ORDERS_AS_OF).cast("timestamp_ntz").alias(c) for c in ("order_date", "created_at", "updated_at")])
    items = t.raw("lineitem").select(
        F.col("l_partkey").alias("order_id"), F.col("l_orderkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    docs = documents.order_documents(orders, items, ORDERS_AS_OF, max_items=10)
    kept = latest.latest_by_key(docs, ["doc_key"], ["expires_at", "doc"])
    body = F.from_json("doc", "item_count bigint, parts int, items array<struct<quantity:int>>")
    told = kept.select(F.regexp_replace("doc_key", ":items:.*", "").alias("doc_key"), body.alias("d"))
    quantity = F.aggregate("d.items.quantity", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return told.groupBy("doc_key").agg(
        F.max("d.item_count").alias("item_count"), F.max("d.parts").alias("parts"),
        F.sum(F.when(F.col("d.items").isNotNull(), quantity)).alias("quantity"),
        F.sum(F.when(F.col("d.items").isNotNull(), F.size("d.items"))).alias("told"))


@query(f"""
SELECT entity, COUNT(*) AS synced, MIN(expires_at) AS expires_at FROM (
  SELECT 'user' AS entity, {EXPIRY} AS expires_at FROM {SQL_USERS} WHERE updated_at > {NOW} - INTERVAL 1 DAY
  UNION ALL SELECT 'product', {EXPIRY} FROM part
    WHERE TIMESTAMP '2001-07-31 12:00:00' + to_hours(CAST(p_partkey % 48 AS INTEGER)) > {NOW} - INTERVAL 1 DAY
  UNION ALL SELECT 'order', {EXPIRY} FROM (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE {TOUCHED} > {NOW} - INTERVAL 1 DAY)
  UNION ALL SELECT 'order_items', {EXPIRY} FROM (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE {TOUCHED} > {NOW} - INTERVAL 1 DAY)
  UNION ALL SELECT 'user_features', {EXPIRY} FROM customer) GROUP BY entity""")
def sync_totals(t: Tables) -> DataFrame:
    tables = {"users": t.users(), "products": t.store_products(), "orders": t.orders(),
              "order_items": t.order_items()}
    return documents.sync_all(tables, ORDERS_AS_OF, 24, CATEGORIES).groupBy("entity").agg(
        F.count(F.lit(1)).alias("synced"), F.min("expires_at").alias("expires_at"))


def _unpivot_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'customer' AS entity_type, CAST(customer_id AS VARCHAR) AS entity_id, '{c}' AS feature_name, "
        f"CAST({c} AS DOUBLE) AS number, {NOW} AS written_at, {NOW} + INTERVAL 7 DAY AS expires_at "
        f"FROM {table} WHERE {c} IS NOT NULL" for c in columns)


@query("WITH f AS (" + _customer_sql(f"AND p.{SINCE_30}", "") + ") " + _unpivot_sql("f", {
    c: "" for c in ("customer_purchase_count_30d", "customer_total_purchases_30d", "customer_avg_purchase_30d",
                    "customer_days_since_last_purchase", "customer_account_age_days")}))
def store_unpivot(t: Tables) -> DataFrame:
    wide = batch_features.customer_features(t.customers(), t.purchases(), ORDERS_AS_OF, 30, keep_inactive=True)
    rows = feature_store.store_features_batch(wide, "customer", ORDERS_AS_OF)
    return rows.withColumn("number", F.col("value").cast("double")).drop("value")


@query(f"""WITH f AS ({_customer_sql("", f"WHERE p.{SINCE_30} OR p.created_at IS NULL")}),
g AS ({_product_sql(_dated(f"LEFT JOIN {SQL_PURCHASES}"),
                    f"WHERE i.purchase_date >= {NOW} - INTERVAL 30 DAY OR i.purchase_date IS NULL")})
SELECT 'customer' AS entity_type, COUNT(*) AS entities, CAST(SUM(customer_purchase_count_30d) AS BIGINT) AS purchases FROM f
UNION ALL SELECT 'product', COUNT(*), CAST(SUM(product_purchase_count_30d) AS BIGINT) FROM g""")
def feature_run_totals(t: Tables) -> DataFrame:
    tables = {"customers": t.customers(), "products": t.products(), "purchases": t.purchases(),
              "purchase_items": t.purchase_items()}
    frames = batch_features.run(tables, ("customer", "product"), 30, ORDERS_AS_OF)
    totals = [df.agg(F.lit(kind).alias("entity_type"), F.count(F.lit(1)).alias("entities"),
                     F.sum(f"{kind}_purchase_count_30d").alias("purchases")) for kind, df in frames.items()]
    return totals[0].unionByName(totals[1])


@query(f"SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM {SQL_PURCHASES} WHERE created_at >= {NOW} - INTERVAL 90 DAY")
def retention_purchases(t: Tables) -> DataFrame:
    return latest.retain(t.purchases(), "created_at", 90, ORDERS_AS_OF).withColumn("amount", F.col("amount").cast("double"))


@query(f"SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM {SQL_PURCHASES} ORDER BY purchase_id LIMIT 1000 OFFSET 1000")
def listing_page(t: Tables) -> DataFrame:
    return latest.page(t.purchases().withColumn("amount", F.col("amount").cast("double")), ["purchase_id"], 1000, 1)
