"""The sample feature definitions and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TEAM = "data_science_team"

# The twelve sample definitions.
DEFINITIONS = (
    {"name": "customer_days_since_last_active", "description": "Number of days since the customer was last active",
     "entity_type": "customer", "value_type": "INTEGER", "source": "DERIVED", "category": "BEHAVIORAL",
     "frequency": "DAILY", "owner": TEAM, "tags": ("recency", "engagement", "core"),
     "transformations": ({"type": "max", "field": "event_timestamp", "alias": "last_active"},
                         {"type": "datediff", "args": ["current_date", "last_active"]})},
    {"name": "customer_event_count", "description": "Total number of events generated by the customer",
     "entity_type": "customer", "value_type": "INTEGER", "source": "DERIVED", "category": "BEHAVIORAL",
     "frequency": "DAILY", "owner": TEAM, "tags": ("frequency", "engagement", "core"),
     "transformations": ({"type": "count", "field": "*"},)},
    {"name": "customer_active_days", "description": "Number of days the customer was active",
     "entity_type": "customer", "value_type": "INTEGER", "source": "DERIVED", "category": "BEHAVIORAL",
     "frequency": "DAILY", "owner": TEAM, "tags": ("frequency", "engagement", "core"),
     "transformations": ({"type": "distinct_count", "field": "date(event_timestamp)"},)},
    {"name": "product_view_count", "description": "Number of times a product was viewed",
     "entity_type": "product", "value_type": "INTEGER", "source": "DERIVED", "category": "POPULARITY",
     "frequency": "DAILY", "owner": TEAM, "tags": ("popularity", "core"),
     "transformations": ({"type": "count", "field": "*", "filter": "event_type = 'view'"},)},
    {"name": "product_purchase_count", "description": "Number of times a product was purchased",
     "entity_type": "product", "value_type": "INTEGER", "source": "DERIVED", "category": "POPULARITY",
     "frequency": "DAILY", "owner": TEAM, "tags": ("popularity", "conversion", "core"),
     "transformations": ({"type": "count", "field": "*", "filter": "event_type = 'purchase'"},)},
    {"name": "product_cart_count", "description": "Number of times a product was added to cart",
     "entity_type": "product", "value_type": "INTEGER", "source": "DERIVED", "category": "POPULARITY",
     "frequency": "DAILY", "owner": TEAM, "tags": ("popularity", "conversion", "core"),
     "transformations": ({"type": "count", "field": "*", "filter": "event_type = 'add_to_cart'"},)},
    {"name": "customer_product_interaction_count",
     "description": "Total number of interactions between a customer and a product",
     "entity_type": "customer_product", "value_type": "INTEGER", "source": "DERIVED", "category": "INTERACTION",
     "frequency": "DAILY", "owner": TEAM, "tags": ("interaction", "recommendations", "core"),
     "transformations": ({"type": "count", "field": "*"},)},
    {"name": "customer_product_view_count", "description": "Number of times a customer viewed a product",
     "entity_type": "customer_product", "value_type": "INTEGER", "source": "DERIVED", "category": "INTERACTION",
     "frequency": "DAILY", "owner": TEAM, "tags": ("interaction", "recommendations", "core"),
     "transformations": ({"type": "count", "field": "*", "filter": "event_type = 'view'"},)},
    {"name": "customer_product_cart_count", "description": "Number of times a customer added a product to cart",
     "entity_type": "customer_product", "value_type": "INTEGER", "source": "DERIVED", "category": "INTERACTION",
     "frequency": "DAILY", "owner": TEAM, "tags": ("interaction", "recommendations", "conversion", "core"),
     "transformations": ({"type": "count", "field": "*", "filter": "event_type = 'add_to_cart'"},)},
    {"name": "customer_product_purchase_count", "description": "Number of times a customer purchased a product",
     "entity_type": "customer_product", "value_type": "INTEGER", "source": "DERIVED", "category": "INTERACTION",
     "frequency": "DAILY", "owner": TEAM, "tags": ("interaction", "recommendations", "conversion", "core"),
     "transformations": ({"type": "count", "field": "*", "filter": "event_type = 'purchase'"},)},
    {"name": "customer_purchase_frequency", "description": "Average number of purchases per active day",
     "entity_type": "customer", "value_type": "FLOAT", "source": "DERIVED", "category": "BEHAVIORAL",
     "frequency": "DAILY", "owner": TEAM, "tags": ("frequency", "monetization", "advanced"),
     "transformations": ({"type": "count", "field": "*", "filter": "event_type = 'purchase'", "alias": "purchase_count"},
                         {"type": "distinct_count", "field": "date(event_timestamp)", "alias": "active_days"},
                         {"type": "division", "args": ["purchase_count", "active_days"]})},
    {"name": "product_conversion_rate", "description": "Percentage of views that result in purchase",
     "entity_type": "product", "value_type": "FLOAT", "source": "DERIVED", "category": "CONVERSION",
     "frequency": "DAILY", "owner": TEAM, "tags": ("conversion", "monetization", "advanced"),
     "transformations": ({"type": "count", "field": "*", "filter": "event_type = 'view'", "alias": "view_count"},
                         {"type": "count", "field": "*", "filter": "event_type = 'purchase'", "alias": "purchase_count"},
                         {"type": "division", "args": ["purchase_count", "view_count"]})},
)

# The four sample groups.
GROUPS = (
    {"name": "customer_engagement_features", "description": "Features measuring customer engagement",
     "entity_type": "customer", "owner": TEAM, "tags": ("engagement", "core"),
     "feature_names": ("customer_days_since_last_active", "customer_event_count", "customer_active_days")},
    {"name": "product_popularity_features", "description": "Features measuring product popularity",
     "entity_type": "product", "owner": TEAM, "tags": ("popularity", "core"),
     "feature_names": ("product_view_count", "product_purchase_count", "product_cart_count")},
    {"name": "customer_product_interaction_features", "description": "Features measuring customer-product interactions",
     "entity_type": "customer_product", "owner": TEAM, "tags": ("interaction", "recommendations", "core"),
     "feature_names": ("customer_product_interaction_count", "customer_product_view_count",
                       "customer_product_cart_count", "customer_product_purchase_count")},
    {"name": "conversion_features", "description": "Features measuring conversion",
     "entity_type": "mixed", "owner": TEAM, "tags": ("conversion", "monetization", "advanced"),
     "feature_names": ("customer_purchase_frequency", "product_conversion_rate",
                       "customer_product_cart_count", "customer_product_purchase_count")},
)


def definition_rows(spark: SparkSession) -> DataFrame:
    """The definitions as registry input; transformations as JSON text."""
    import json

    plain = ("name", "description", "entity_type", "value_type", "source", "category", "frequency", "owner")
    rows = [(*[d[c] for c in plain], list(d["tags"]), json.dumps(d["transformations"])) for d in DEFINITIONS]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in plain) +
                                 ", tags array<string>, transformations string")


def group_rows(spark: SparkSession) -> DataFrame:
    rows = [(g["name"], g["description"], list(g["feature_names"]), g["entity_type"], g["owner"], list(g["tags"])) for g in GROUPS]
    return spark.createDataFrame(rows, "name string, description string, feature_names array<string>, "
                                       "entity_type string, owner string, tags array<string>")


def empty_registry(spark: SparkSession) -> DataFrame:
    from featloom.schemas import VERSIONS

    now = F.lit(None).cast("timestamp_ntz")
    return (definition_rows(spark).withColumn("versions", F.lit(None).cast(VERSIONS))
            .withColumn("created_at", now).withColumn("updated_at", now).limit(0))


def empty_groups(spark: SparkSession) -> DataFrame:
    now = F.lit(None).cast("timestamp_ntz")
    return group_rows(spark).withColumn("created_at", now).withColumn("updated_at", now).limit(0)
