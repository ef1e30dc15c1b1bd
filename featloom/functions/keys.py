"""Composite entity ids and key strings of the online store."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Entity types and the id columns of their offline tables.
ENTITY_IDS = {
    "customer": ("customer_id",),
    "product": ("product_id",),
    "customer_product": ("customer_id", "product_id"),
}


def joined(*parts: Column) -> Column:
    """Parts joined by `:`; NULL if any part is NULL."""
    out = parts[0].cast("string")
    for part in parts[1:]:
        out = F.concat(out, F.lit(":"), part.cast("string"))
    return out


def online_key(entity_type: Column | str, entity_id: Column, feature: Column) -> Column:
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return joined(kind, entity_id, feature)


def key_parts(key: Column) -> Column:
    return F.split(key, ":")


def key_has_shape(key: Column, id_count: int) -> Column:
    """A key of type, `id_count` ids and feature name; ids holding `:` do not pass."""
    return F.size(key_parts(key)) == id_count + 2
