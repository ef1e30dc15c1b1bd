"""Key-document views of operational tables, as kept in an online document store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featloom.functions.time import Instant, instant, interval
from featloom.operators.latest import changed_since
from featloom.operators.nesting import page_children
from featloom.plans import batch_features
from featloom.schemas import DOCUMENT_TTL

# Columns of each document.
USER_FIELDS = ("username", "email", "created_at", "updated_at", "last_login")
PRODUCT_FIELDS = ("name", "description", "price", "inventory", "category", "created_at", "updated_at")
ORDER_FIELDS = ("user_id", "order_date", "status", "total_amount", "created_at", "updated_at")
ITEM_FIELDS = ("product_id", "quantity", "price")


def json_ready(df: DataFrame, column: str) -> Column:
    """Timestamps as ISO text, with microseconds where there are any; decimals as doubles; NULL stays NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(F.col(column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.regexp_replace(text, r"\.000000$", "").alias(column)
    if isinstance(kind, T.DecimalType):
        return F.col(column).cast("double").alias(column)
    return F.col(column)


def documents(df: DataFrame, prefix: str, id_column: str, fields: Sequence[str],
              ttl_seconds: int = DOCUMENT_TTL, as_of: Instant = None) -> DataFrame:
    """(doc_key, doc, expires_at): the fields of each row as one JSON text under `prefix:id`."""
    body = F.to_json(F.struct(*[json_ready(df, c) for c in fields]), {"ignoreNullFields": "false"})
    return df.select(
        F.concat(F.lit(prefix + ":"), F.col(id_column).cast("string")).alias("doc_key"),
        body.alias("doc"),
        (instant(as_of, "timestamp_ntz") + interval(ttl_seconds, "second")).alias("expires_at"))


def user_documents(users: DataFrame, as_of: Instant = None, hours: float = 24,
                   ttl_seconds: int = DOCUMENT_TTL) -> DataFrame:
    changed = changed_since(users, "updated_at", hours, as_of, strict=True)
    return documents(changed, "user", "user_id", USER_FIELDS, ttl_seconds, as_of)


def product_documents(products: DataFrame, as_of: Instant = None, hours: float = 24,
                      ttl_seconds: int = DOCUMENT_TTL) -> DataFrame:
    changed = changed_since(products, "updated_at", hours, as_of, strict=True)
    return documents(changed, "product", "product_id", PRODUCT_FIELDS, ttl_seconds, as_of)


def order_documents(orders: DataFrame, order_items: DataFrame, as_of: Instant = None,
                    hours: float = 24, ttl_seconds: int = DOCUMENT_TTL,
                    max_items: int = 10_000) -> DataFrame:
    """Changed orders and their items; orders without items are left out.

    `order:{id}` holds the order with its `item_count` and number of `parts`;
    `order:{id}:items:{part}` holds a page of its items. The layout does not depend on the
    number of items, and every key is one document. Items of orders that did not change are
    dropped before nesting.
    """
    changed = changed_since(orders, "updated_at", hours, as_of, strict=True)
    items = (order_items.join(changed.select("order_id"), "order_id", "left_semi")
             .select("order_id", "product_id", "quantity", F.col("price").cast("double").alias("price")))
    sizes, pages = page_children(items, "order_id", ITEM_FIELDS, max_items=max_items)
    headers = documents(changed.join(sizes, "order_id"), "order", "order_id",
                        (*ORDER_FIELDS, "item_count", "parts"), ttl_seconds, as_of)
    place = F.concat(F.col("order_id").cast("string"), F.lit(":items:"), F.col("part").cast("string"))
    return headers.unionByName(documents(pages.withColumn("place", place), "order", "place",
                                         ("order_id", "part", "items"), ttl_seconds, as_of))


def user_vector_documents(vectors: DataFrame, as_of: Instant = None,
                          ttl_seconds: int = DOCUMENT_TTL) -> DataFrame:
    fields = [c for c in vectors.columns if c != "user_id"]
    return documents(vectors, "user_features", "user_id", fields, ttl_seconds, as_of)


def sync_all(tables: dict[str, DataFrame], as_of: Instant = None, hours: float = 24,
             categories: dict[str, str] | None = None) -> DataFrame:
    """One full pass over users, products, orders and user vectors; pages of items are an entity of their own.

    Counts per entity come from an observation on the write, not from a second job:
    `sync_all(...).observe(obs, count(...))`.
    """
    t = tables
    vectors = batch_features.user_vectors(
        t["users"], t["orders"], t["order_items"], t["products"], categories, as_of)
    parts = [user_documents(t["users"], as_of, hours),
             product_documents(t["products"], as_of, hours),
             order_documents(t["orders"], t["order_items"], as_of, hours),
             user_vector_documents(vectors, as_of)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kind = F.substring_index("doc_key", ":", 1)
    pages = (kind == "order") & F.contains("doc_key", F.lit(":items:"))
    return out.withColumn("entity", F.when(pages, F.lit("order_items")).otherwise(kind))
