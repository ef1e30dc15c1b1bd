"""Feature values as text: encoding, decoding, coercion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def encode(value: Column, data_type: T.DataType) -> Column:
    """Strings stay raw, everything else becomes JSON text; NULL stays NULL."""
    if isinstance(data_type, T.StringType):
        return value
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return value.cast("string")


def is_present(value: Column, data_type: T.DataType) -> Column:
    """Neither NULL nor NaN."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def is_json(text: Column) -> Column:
    """Decodable, non-empty JSON text."""
    return (F.length(text) > 0) & F.try_parse_json(text).isNotNull()


def decoded_text(text: Column) -> Column:
    """A JSON string without its quotes, JSON null as NULL, any other text as it is."""
    quoted = F.try_variant_get(F.try_parse_json(text), "$", "string")
    bare = F.trim(text)
    return (F.when(bare == "null", F.lit(None))
            .when(bare.startswith('"'), F.coalesce(quoted, text)).otherwise(text))


def as_number(text: Column) -> Column:
    """Numeric coercion of a stored value: booleans count as 0 and 1, other text is NULL."""
    plain = F.trim(decoded_text(text))
    return (F.when(F.lower(plain) == "true", F.lit(1.0))
            .when(F.lower(plain) == "false", F.lit(0.0))
            .otherwise(plain.try_cast("double")))


def as_double(value: Column) -> Column:
    return value.cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


# Registry value types and the Spark type a value is read as.
VALUE_TYPES = {
    "INT": "bigint",
    "INTEGER": "bigint",
    "FLOAT": "double",
    "STRING": "string",
    "BOOL": "boolean",
    "ARRAY": "array<string>",
    "MAP": "map<string,string>",
    "TIMESTAMP": "timestamp",
}


def typed(text: Column, value_type: str) -> Column:
    """A stored value read as its registered type; NULL where it does not fit."""
    target = VALUE_TYPES[value_type]
    if target.startswith(("array", "map")):
        return F.from_json(text, target)
    return decoded_text(text).try_cast(target)
