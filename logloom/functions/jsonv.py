"""Strict access to JSON values held as VARIANT: a value of another type counts as absent, nothing is coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The parser's own limit of 20 million characters a string would make a record with a large inline image unreadable.
_LIMITS = {"maxStringLen": str(2**31 - 1)}


def parse_line(line: Column) -> Column:
    """VARIANT of a one-value JSON text, null when malformed (trailing text included) or nested over 1000 levels deep."""
    wrapped = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "variant", _LIMITS)
    return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull(),
                  F.try_variant_get(wrapped, "$[0]", "variant"))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def obj_at(v: Column, path: str) -> Column:
    child = at(v, path)
    return F.when(is_object(child), child)


def arr_at(v: Column, path: str) -> Column:
    """Array of variants, null when the value is no array."""
    return F.try_variant_get(v, path, "array<variant>")


def str_at(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def num_at(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(at(v, path))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(v, path, "double"))


def long_at(v: Column, path: str) -> Column:
    return num_at(v, path).cast("bigint")


def truthy(v: Column, path: str) -> Column:
    """Neither absent, null, false, zero nor the empty string."""
    child = at(v, path)
    text = F.try_variant_get(v, path, "string")
    return child.isNotNull() & text.isNotNull() & ~text.isin("", "false", "0", "0.0")


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def json_text(v: Column) -> Column:
    """Text of a value: strings as they are, everything else as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
