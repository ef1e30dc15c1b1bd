"""Declarative feature definitions turned into Spark aggregations.

All definitions of one entity type are computed by a single `groupBy(...).agg(...)`:
first every aggregate any definition needs, then the steps that combine aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from featloom.functions.time import Instant, instant
from featloom.functions.values import VALUE_TYPES, ratio
from featloom.plans import golden
from featloom.session import written

CART_EVENT = "add_to_cart"

# Functions an `aggregation` step may name.
AGGREGATES = {
    "sum": F.sum, "count": F.count, "avg": F.avg, "mean": F.avg,
    "min": F.min, "max": F.max, "count_distinct": F.count_distinct,
}
ROW_STEPS = ("count", "distinct_count", "max", "min", "sum", "avg", "aggregation")
_NOW = re.compile(r"\b(?:NOW\(\)|CURRENT_TIMESTAMP(?:\(\))?)", re.IGNORECASE)
_TODAY = re.compile(r"\bCURRENT_DATE(?:\(\))?", re.IGNORECASE)


@dataclass(frozen=True)
class Definition:
    name: str
    entity_type: str
    value_type: str
    transformations: tuple[dict, ...]
    source_config: dict = field(default_factory=dict)


# The evaluation time where it is a column.
MOMENT = "_as_of"
_AGGREGATE_CALL = re.compile(r"\s*\w+\s*\(.*\)\s*", re.DOTALL)


def _sql(text: str, as_of: Instant) -> str:
    """A user's SQL expression with the current time replaced by the evaluation time."""
    if as_of is None:
        return text
    moment = MOMENT if isinstance(as_of, Column) else f"TIMESTAMP_NTZ '{as_of}'"
    return _TODAY.sub(f"CAST({moment} AS DATE)", _NOW.sub(moment, text))


def _aggregate(step: dict, conditions: list[str], as_of: Instant) -> Column:
    kind = step["type"]
    target = step.get("field", step.get("column", "*"))
    value = F.lit(1) if target == "*" else F.expr(_sql(target, as_of))
    if conditions:
        value = F.when(F.expr(" AND ".join(f"({_sql(c, as_of)})" for c in conditions)), value)
    if kind == "aggregation":
        return AGGREGATES[step["function"]](value)
    return {"count": F.count, "distinct_count": F.count_distinct, "max": F.max,
            "min": F.min, "sum": F.sum, "avg": F.avg}[kind](value)


def compute(df: DataFrame, definitions: Sequence[Definition], entity_columns: Sequence[str],
            as_of: Instant = None) -> DataFrame:
    """One row per entity with a column per definition, typed by its value type.

    `as_of` may be a column: the current time of each row, the latest of an entity's rows
    where aggregates are compared with it.
    """
    aggregates: dict[str, Column] = {}
    if isinstance(as_of, Column):
        df = df.withColumn(MOMENT, as_of.cast("timestamp_ntz"))
        aggregates[MOMENT] = F.max(MOMENT)
    steps, outputs = _planned(definitions, as_of)
    for slot, (step, where) in steps.items():
        aggregates[slot] = (_filtered_call(step["name"], step["to"], where, as_of) if step["type"] == "date_diff"
                            else _aggregate(step, where, as_of))
    grouped = df.groupBy(*entity_columns).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(*entity_columns, *outputs)


def _planned(definitions: Sequence[Definition], as_of: Instant) -> tuple[dict[str, tuple[dict, list[str]]], list[Column]]:
    """(the aggregates that the definitions need: step and conditions by name, a column for each definition)"""
    if len({d.entity_type for d in definitions}) != 1:
        raise ValueError("definitions of one call must share an entity type")
    steps: dict[str, tuple[dict, list[str]]] = {}
    by_text: dict[tuple, str] = {}
    outputs: list[Column] = []
    for d in definitions:
        names: dict[str, str] = {}
        result: Column | None = None
        for step in d.transformations:
            kind = step["type"]
            where = [c for c in (d.source_config.get("filter"), step.get("filter")) if c]
            if kind in ROW_STEPS:
                text = (*where, *sorted((k, str(v)) for k, v in step.items() if k not in ("alias", "filter")))
                slot = by_text.get(text)
                if slot is None:
                    slot = by_text[text] = f"_a{len(steps)}"
                    steps[slot] = step, where
                result = F.col(slot)
                if "alias" in step:
                    names[step["alias"]] = slot
            elif kind == "date_diff":
                slot = f"_a{len(steps)}"
                steps[slot] = {**step, "name": d.name}, where
                result = F.datediff(F.expr(_sql(step["from"], as_of)), F.col(slot))
            elif kind == "datediff":
                end, start = (_argument(a, names, as_of) for a in step["args"])
                result = F.datediff(end, start)
            elif kind == "division":
                result = ratio(*(_argument(a, names, as_of) for a in step["args"]))
            else:
                raise ValueError(f"{d.name}: unknown step type {kind!r}")
        if result is None:
            raise ValueError(f"{d.name}: no transformation")
        outputs.append(result.cast(VALUE_TYPES[d.value_type]).alias(d.name))
    return steps, outputs


#: How an aggregate over rows comes from aggregates over parts of them.
MERGES = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def compute_grains(df: DataFrame, grains: Sequence[tuple[Sequence[str], Sequence[Definition]]],
                   as_of: str | None = None) -> list[DataFrame]:
    """`compute` for definitions of several grains, (entity columns, definitions) each, with one read of the rows.

    The rows are aggregated once by all entity columns together and by the values that are counted distinct; this
    is written, and every grain is merged from it: counts and sums are added, extremes compared, and a distinct
    count is one over the values of the parts. Definitions need counts, sums, extremes and distinct counts of one
    expression, and what is computed from these.
    """
    planned = [(list(ids), *_planned(definitions, as_of)) for ids, definitions in grains]
    entities = list(dict.fromkeys(c for ids, _, _ in planned for c in ids))
    partial: dict[tuple, str] = {}     # name of a partial aggregate by its meaning
    columns: dict[str, Column] = {}
    counted: str | None = None         # the expression that is counted distinct

    def part(kind: str, target: str, where: list[str]) -> str:
        name = partial.setdefault((kind, target, *where), f"_p{len(partial)}")
        if name not in columns:
            columns[name] = _aggregate({"type": kind, "field": target}, where, as_of)
        return name

    merged = []
    for ids, steps, outputs in planned:
        out = {}
        for slot, (step, where) in steps.items():
            target = step.get("field", step.get("column", "*"))
            kind = step.get("function") if step["type"] == "aggregation" else step["type"]
            if kind in ("distinct_count", "count_distinct"):
                if counted not in (None, target):
                    raise ValueError(f"distinct counts of {counted} and {target} cannot share a read")
                counted = target
                seen = F.col(part("count", "*", where)) > 0
                out[slot] = F.count_distinct(F.when(seen, F.col("_value")))
            elif kind in MERGES:
                out[slot] = MERGES[kind](part(kind, target, where))
            else:
                raise ValueError(f"a step of type {step['type']!r} cannot be merged from parts")
        merged.append((ids, out, outputs))
    value = F.expr(_sql(counted, as_of)) if counted else F.lit(None).cast("string")
    parts = written(df.withColumn("_value", value).groupBy(*entities, "_value").agg(*[c.alias(n) for n, c in columns.items()]), "grains")
    return [parts.groupBy(*ids).agg(*[c.alias(n) for n, c in out.items()]).select(*ids, *outputs) for ids, out, outputs in merged]


def _filtered_call(name: str, call: str, conditions: list[str], as_of: Instant) -> Column:
    """A user's aggregate call over the rows that meet the conditions."""
    text = _sql(call, as_of)
    if conditions:
        if not _AGGREGATE_CALL.fullmatch(text):
            raise ValueError(f"{name}: a filter needs a single aggregate call, not {call!r}")
        text += " FILTER (WHERE " + " AND ".join(f"({_sql(c, as_of)})" for c in conditions) + ")"
    return F.expr(text)


def _argument(name: str, names: dict[str, str], as_of: Instant) -> Column:
    if name in names:
        return F.col(names[name])
    if name.lower() == "current_date":
        return (F.col(MOMENT) if isinstance(as_of, Column) else instant(as_of)).cast("date")
    return F.expr(_sql(name, as_of))


def of_registry(entries: Sequence[dict], entity_type: str, cart_event: str = CART_EVENT) -> tuple[Definition, ...]:
    """The definitions of one entity type; `cart_event` names the event that puts a product into a cart."""
    def step(s: dict) -> dict:
        return {k: v.replace(f"'{CART_EVENT}'", f"'{cart_event}'") if k == "filter" else v for k, v in s.items()}
    return tuple(Definition(e["name"], e["entity_type"], e["value_type"], tuple(map(step, e["transformations"])),
                            e.get("source_config", {})) for e in entries if e["entity_type"] == entity_type)


CUSTOMER_EVENT_FEATURES = of_registry(golden.DEFINITIONS, "customer")


def product_event_features(cart_event: str = CART_EVENT) -> tuple[Definition, ...]:
    return of_registry(golden.DEFINITIONS, "product", cart_event)


def customer_product_event_features(cart_event: str = CART_EVENT) -> tuple[Definition, ...]:
    return of_registry(golden.DEFINITIONS, "customer_product", cart_event)


# The sample definitions over purchases.
_LAST_30_DAYS = "purchase_date >= NOW() - INTERVAL '30 days'"
CUSTOMER_PURCHASE_FEATURES = (
    Definition("customer_total_purchases_30d", "customer", "FLOAT",
               ({"type": "aggregation", "function": "sum", "column": "purchase_amount"},),
               {"table": "customer_purchases", "filter": _LAST_30_DAYS}),
    Definition("customer_days_since_last_purchase", "customer", "INT",
               ({"type": "date_diff", "from": "NOW()", "to": "MAX(purchase_date)"},),
               {"table": "customer_purchases"}),
)
PRODUCT_PURCHASE_FEATURES = (
    Definition("product_purchase_count_30d", "product", "INT",
               ({"type": "aggregation", "function": "count", "column": "purchase_id"},),
               {"table": "purchase_items", "filter": _LAST_30_DAYS}),
)

FEATURE_GROUPS = {g["name"]: g["feature_names"] for g in golden.GROUPS}
