"""The query registry and the test tables seen under the library's table names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from featloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL that must agree with it."""
    def wrap(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return fn
    return wrap


class Tables:
    """The given tables, and views of them shaped like the library's inputs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    # purchases ---------------------------------------------------------------
    def customers(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("email"),
            F.expr("TIMESTAMP_NTZ '1995-01-01' + make_dt_interval(cast(c_custkey % 365 as int))").alias("created_at"))

    def purchases(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("purchase_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.col("o_orderdate").alias("created_at"))

    def purchase_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("purchase_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"))

    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.expr("TIMESTAMP_NTZ '1995-01-01' + make_dt_interval(cast(p_partkey % 365 as int))").alias("created_at"))

    # operational tables ------------------------------------------------------
    def users(self) -> DataFrame:
        hours = "make_dt_interval(0, cast(c_custkey % 48 as int))"
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.expr("TIMESTAMP_NTZ '1995-01-01' + make_dt_interval(cast(c_custkey % 365 as int))").alias("created_at"),
            F.expr(f"TIMESTAMP_NTZ '2001-07-31 12:00:00' + {hours}").alias("updated_at"),
            F.expr(f"if(c_custkey % 3 = 0, NULL, TIMESTAMP_NTZ '2001-07-01' + {hours})").alias("last_login"))

    def store_products(self) -> DataFrame:
        hours = "make_dt_interval(0, cast(p_partkey % 48 as int))"
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
            F.lit(None).cast("string").alias("description"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
            F.col("p_size").cast("int").alias("inventory"), F.col("p_type").alias("category"),
            F.expr("TIMESTAMP_NTZ '1995-01-01' + make_dt_interval(cast(p_partkey % 365 as int))").alias("created_at"),
            F.expr(f"TIMESTAMP_NTZ '2001-07-31 12:00:00' + {hours}").alias("updated_at"))

    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
            F.col("o_orderdate").alias("created_at"),
            F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, "
                   "if(o_orderkey % 2 = 0, 0, cast(o_orderkey % 1000000 as decimal(18,6)) / 1000000))").alias("updated_at"))

    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
            F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))

    # events ------------------------------------------------------------------
    def events(self) -> DataFrame:
        return self.raw("events")

    def customer_events(self) -> DataFrame:
        """Events with the columns the sample definitions name."""
        return self.events().select(
            F.col("user_id").alias("customer_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
            "event_type", F.col("ts").alias("event_timestamp"))

    def tall_features(self) -> DataFrame:
        """Events as offline values: the event type is the feature, the value its JSON text."""
        return self.events().select(
            F.col("user_id").alias("customer_id"), F.col("event_type").alias("feature_name"),
            F.col("value").cast("string").alias("feature_value"), F.col("ts").alias("timestamp"))

    def prediction_log(self) -> DataFrame:
        return self.events().select(
            F.col("event_id").cast("string").alias("request_id"),
            F.concat(F.lit("model-"), F.col("user_id") % 2).alias("model_name"),
            F.concat(F.lit("v"), F.col("user_id") % 3).alias("model_version"),
            "ts", F.col("value").alias("prediction"), F.col("value").alias("latency_ms"),
            F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
            F.when(F.col("event_type") == "view", F.col("value") / 500).alias("drift_score"),
            F.concat(F.lit("job-"), F.col("user_id") % 5).alias("job"), "user_id")


# The same views in SQL.
SQL_CUSTOMERS = """(SELECT c_custkey AS customer_id,
  TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at FROM customer)"""
SQL_PRODUCTS = """(SELECT p_partkey AS product_id, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
  TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)) AS created_at FROM part)"""
SQL_PURCHASES = """(SELECT o_orderkey AS purchase_id, o_custkey AS customer_id,
  CAST(o_totalprice AS DECIMAL(12,2)) AS amount, o_orderdate AS created_at FROM orders)"""
SQL_ITEMS = """(SELECT l_orderkey AS purchase_id, l_partkey AS product_id,
  CAST(l_quantity AS INTEGER) AS quantity FROM lineitem)"""
SQL_TALL = """(SELECT user_id AS customer_id, event_type AS feature_name,
  CAST(value AS VARCHAR) AS feature_value, ts AS "timestamp" FROM events)"""
SQL_LOG = """(SELECT CAST(event_id AS VARCHAR) AS request_id, 'model-' || (user_id % 2) AS model_name,
  'v' || (user_id % 3) AS model_version, ts, value AS prediction, value AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error,
  CASE WHEN event_type = 'view' THEN value / 500 END AS drift_score,
  'job-' || (user_id % 5) AS job, user_id FROM events)"""
