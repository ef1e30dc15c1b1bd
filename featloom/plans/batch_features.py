"""Customer, product and customer-product purchase features, and user feature vectors.

Purchases are aggregated to one row per entity before they meet the entity table:
the aggregation combines on the map side, so an entity with very many purchases
costs one row per task, and the join that follows has unique keys on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featloom.functions.keys import joined
from featloom.functions.time import Instant, days_between, instant, instant_like, interval
from featloom.functions.values import as_double, ratio

ENTITY_TYPES = ("customer", "product", "customer_product")


def _recent_or_undated(df: DataFrame, moment: str, as_of: Instant, days: int) -> Column:
    since = instant_like(df, moment, as_of) - interval(days, "day")
    return (F.col(moment) >= since) | F.col(moment).isNull()


def customer_features(customers: DataFrame, purchases: DataFrame, as_of: Instant = None,
                      lookback_days: int = 30, keep_inactive: bool = False) -> DataFrame:
    """Purchase features per customer.

    By default a customer whose purchases are all older than the lookback is left
    out, while one with no purchases at all stays with count 0 and NULL sums: the
    date filter applies to the rows of the outer join. `keep_inactive` filters
    purchases before the join instead, which keeps every customer and lets the
    filter reach the file scan.
    """
    recent = _recent_or_undated(purchases, "created_at", as_of, lookback_days)
    wanted = purchases.filter(recent) if keep_inactive else purchases
    in_window = lambda c: F.when(recent, F.col(c))
    spent = wanted.groupBy("customer_id").agg(
        F.count(in_window("purchase_id")).alias("_n"),
        F.sum(in_window("amount")).alias("_total"),
        F.count(in_window("amount")).alias("_amounts"),
        F.max(in_window("created_at")).alias("_last"),
        F.count_if(recent).alias("_kept"))
    return customer_rows(customers, spent, as_of, lookback_days, keep_inactive)


def customer_rows(customers: DataFrame, spent: DataFrame, as_of: Instant, lookback_days: int, keep_inactive: bool = False) -> DataFrame:
    """Features from `spent`, the purchases of the lookback reduced to one row per customer: `_n`, `_total`,
    `_amounts`, `_last`, and `_kept`, the number of purchases of the lookback."""
    people = customers.groupBy("customer_id").agg(
        F.min("created_at").alias("_created"), F.count(F.lit(1)).alias("_copies"))
    both = people.join(spent, "customer_id", "left")
    if not keep_inactive:
        both = both.filter(F.col("_kept").isNull() | (F.col("_kept") > 0))
    d = f"{lookback_days}d"
    today = instant(as_of)
    return both.select(
        "customer_id", F.lit("customer").alias("entity_type"),
        F.coalesce(F.col("_n") * F.col("_copies"), F.lit(0)).alias(f"customer_purchase_count_{d}"),
        as_double(F.col("_total") * F.col("_copies")).alias(f"customer_total_purchases_{d}"),
        ratio(F.col("_total"), F.col("_amounts")).alias(f"customer_avg_purchase_{d}"),
        F.datediff(today, F.col("_last")).alias("customer_days_since_last_purchase"),
        F.datediff(today, F.col("_created")).alias("customer_account_age_days"))


def product_features(products: DataFrame, purchase_items: DataFrame, purchases: DataFrame,
                     as_of: Instant = None, lookback_days: int = 30,
                     keep_inactive: bool = False) -> DataFrame:
    """Sales features per product; the lookback treats unsold products as `customer_features` does.

    A product listed with several prices gives one row; its revenue counts each sale at each price.
    """
    recent = _recent_or_undated(purchases, "created_at", as_of, lookback_days)
    dates = purchases.select("purchase_id", "created_at")
    if keep_inactive:
        # only recent (or undated) purchases meet the items: the filter reaches their scan
        sold = purchase_items.join(dates.filter(recent), "purchase_id")
    else:
        # items of no known purchase count like undated ones; one join finds both, so a task sorts its items once
        sold = purchase_items.join(dates, "purchase_id", "left").filter(recent)
    sales = sold.groupBy("product_id").agg(
        F.count("purchase_id").alias("_n"), F.sum("quantity").alias("_quantity"),
        F.max("created_at").alias("_last"), F.count(F.lit(1)).alias("_kept"))
    listed = products.groupBy("product_id").agg(
        F.min("created_at").alias("_created"), F.sum("price").alias("_prices"),
        F.count(F.lit(1)).alias("_copies"))
    both = listed.join(sales, "product_id", "left")
    if not keep_inactive:
        # a product that was sold, but not lately, is left out
        ever = purchase_items.groupBy("product_id").agg(F.lit(True).alias("_ever"))
        both = both.join(ever, "product_id", "left").filter(F.col("_ever").isNull() | F.col("_kept").isNotNull())
    d = f"{lookback_days}d"
    today = instant(as_of)
    return both.select(
        "product_id", F.lit("product").alias("entity_type"),
        F.coalesce(F.col("_n") * F.col("_copies"), F.lit(0)).alias(f"product_purchase_count_{d}"),
        (F.col("_quantity") * F.col("_copies")).alias(f"product_quantity_sold_{d}"),
        as_double(F.col("_quantity") * F.col("_prices")).alias(f"product_revenue_{d}"),
        F.datediff(today, F.col("_last")).alias("product_days_since_last_purchase"),
        F.datediff(today, F.col("_created")).alias("product_age_days"))


def customer_product_features(customers: DataFrame, products: DataFrame, purchases: DataFrame,
                              purchase_items: DataFrame, as_of: Instant = None,
                              lookback_days: int = 90) -> DataFrame:
    """Purchase features per customer and product, within the lookback only.

    Customers and products have unique ids, so joining them only asks for existence:
    customers of the recent purchases, products of the aggregated pairs.
    """
    since = instant_like(purchases, "created_at", as_of) - interval(lookback_days, "day")
    recent = (purchases.filter(F.col("created_at") >= since)
              .select("purchase_id", "customer_id", "created_at")
              .join(customers.select("customer_id"), "customer_id", "left_semi"))
    pairs = (purchase_items.join(recent, "purchase_id")
             .groupBy("customer_id", "product_id")
             .agg(F.count("purchase_id").alias("_n"), F.sum("quantity").alias("_quantity"),
                  F.max("created_at").alias("_last")))
    known = pairs.join(products.select("product_id"), "product_id", "left_semi")
    d = f"{lookback_days}d"
    return known.select(
        joined(F.col("customer_id"), F.col("product_id")).alias("entity_id"),
        F.lit("customer_product").alias("entity_type"),
        F.col("_n").alias(f"customer_product_purchase_count_{d}"),
        F.col("_quantity").alias(f"customer_product_quantity_{d}"),
        F.datediff(instant(as_of), F.col("_last")).alias("customer_product_days_since_last_purchase"))


def run(tables: dict[str, DataFrame], feature_types: Sequence[str] = ENTITY_TYPES,
        lookback_days: int = 30, as_of: Instant = None) -> dict[str, DataFrame]:
    """The chosen feature frames by entity type; one lookback applies to all."""
    unknown = set(feature_types) - set(ENTITY_TYPES)
    if unknown:
        raise ValueError(f"unknown feature types: {sorted(unknown)}")
    t = tables
    build = {
        "customer": lambda: customer_features(
            t["customers"], t["purchases"], as_of, lookback_days),
        "product": lambda: product_features(
            t["products"], t["purchase_items"], t["purchases"], as_of, lookback_days),
        "customer_product": lambda: customer_product_features(
            t["customers"], t["products"], t["purchases"], t["purchase_items"], as_of, lookback_days),
    }
    return {kind: build[kind]() for kind in feature_types}


# Product categories counted in the user vector, with their column names.
CATEGORY_COLUMNS = {"Electronics": "electronics_purchases", "Audio": "audio_purchases"}


def user_vectors(users: DataFrame, orders: DataFrame, order_items: DataFrame, products: DataFrame,
                 categories: dict[str, str] | None = None, as_of: Instant = None) -> DataFrame:
    """Order statistics per user with purchases counted per product category; gaps become 0."""
    categories = categories or CATEGORY_COLUMNS
    per_user = orders.groupBy("user_id").agg(
        F.count("order_id").alias("_n"), F.sum("total_amount").alias("_total"),
        F.count("total_amount").alias("_amounts"), F.max("order_date").alias("_last"))
    wanted = products.filter(F.col("category").isin(list(categories))).select("product_id", "category")
    in_categories = (order_items.select("order_id", "product_id").join(wanted, "product_id")
                     .groupBy("order_id").agg(*[
                         F.count_if(F.col("category") == c).alias(name)
                         for c, name in categories.items()]))
    per_category = (in_categories.join(orders.select("order_id", "user_id"), "order_id")
                    .groupBy("user_id").agg(*[F.sum(n).alias(n) for n in categories.values()]))
    last = F.coalesce(F.col("_last"), F.col("created_at"))
    return (users.select("user_id", "created_at")
            .join(per_user, "user_id", "left").join(per_category, "user_id", "left")
            .select(
                "user_id", F.coalesce("_n", F.lit(0)).alias("order_count"),
                F.coalesce(as_double(F.col("_total")), F.lit(0.0)).alias("total_spent"),
                F.coalesce(ratio(F.col("_total"), F.col("_amounts")), F.lit(0.0)).alias("avg_order_value"),
                F.coalesce(days_between(instant(as_of, "timestamp_ntz"), last), F.lit(0.0))
                .alias("days_since_last_order"),
                *[F.coalesce(n, F.lit(0)).alias(n) for n in categories.values()]))
