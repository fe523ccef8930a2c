"""Token usage structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.jsonv import is_object, long_at
from logloom.schema import USAGE_FIELDS, USAGE_TYPE


def _from_fields(v: Column, fields: list[str], body) -> Column:
    """``body`` of the numeric fields of an object; null when ``v`` is no object.

    One-element transforms hold ``v`` and the fields, so that each is evaluated once.
    """
    def read(x: Column) -> Column:
        raw = F.struct(*[long_at(x, f"$.{f}").alias(f) for f in fields])
        return F.when(is_object(x), F.transform(F.array(raw), body)[0])

    return F.transform(F.array(v), read)[0].cast(USAGE_TYPE)


def _usage(*values: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(values, USAGE_FIELDS)])


def usage_struct(v: Column) -> Column:
    """Usage counters of a provider record; null when ``v`` is no object.

    Explicit cached tokens are part of the input, cache creation and reads come on top of it.
    """
    zero = F.lit(0).cast("bigint")

    def counters(r: Column) -> Column:
        inp, explicit = F.coalesce(r["input_tokens"], zero), r["cached_input_tokens"]
        creation = F.coalesce(r["cache_creation_input_tokens"], zero)
        read = F.coalesce(r["cache_read_input_tokens"], explicit, zero)
        out, reasoning = F.coalesce(r["output_tokens"], zero), F.coalesce(r["reasoning_output_tokens"], zero)
        fresh = F.when(explicit.isNull(), inp).otherwise(F.greatest(zero, inp - explicit))
        total = F.coalesce(r["total_tokens"], inp + creation + read + out + reasoning)
        return _usage(inp, F.coalesce(explicit, creation + read), creation, read, fresh, out, reasoning, total)

    return _from_fields(v, [f for f in USAGE_FIELDS if f != "fresh_input_tokens"], counters)


def usage_struct_cursor(v: Column) -> Column:
    """Usage of a chat bubble's token count; all-zero counts are absent."""
    zero = F.lit(0).cast("bigint")

    def counters(r: Column) -> Column:
        inp = F.coalesce(r["inputTokens"], r["input_tokens"], zero)
        out = F.coalesce(r["outputTokens"], r["output_tokens"], zero)
        total = F.coalesce(r["totalTokens"], r["total_tokens"], inp + out)
        return F.when((inp != 0) | (out != 0) | (total != 0), _usage(inp, zero, zero, zero, inp, out, zero, total))

    return _from_fields(v, ["inputTokens", "input_tokens", "outputTokens", "output_tokens", "totalTokens",
                            "total_tokens"], counters)


def sum_usage(prefix: str = "usage.") -> list[Column]:
    """The eight sums of a usage struct, zero when there are no rows."""
    return [F.coalesce(F.sum(prefix + f), F.lit(0)).cast("bigint").alias(f) for f in USAGE_FIELDS]
