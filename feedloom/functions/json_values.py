"""Strict JSON recovery and scalar coercion on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCED_BLOCK = r"```(?:json)?\s*([\s\S]*?)```"
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strict_json(candidate: Column) -> Column:
    """VARIANT if the text is exactly one JSON value, else null.

    The parser accepts trailing text, so the candidate is wrapped twice: the
    first value must be followed by ``]`` in one wrapping and by ``}`` in the
    other, which only the end of the candidate can satisfy.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), candidate, F.lit("]"))).cast("array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), candidate, F.lit("}")))
    return _let(in_array, lambda a: F.when((F.size(a) == 1) & in_object.isNotNull(), F.get(a, F.lit(0))))


def json_candidates(raw: Column) -> tuple[Column, Column, Column]:
    """Whole text, first fenced block, and first ``{`` to last ``}``."""
    fenced = F.when(raw.contains("```"), F.regexp_extract(raw, FENCED_BLOCK, 1))
    first = F.instr(raw, "{")
    last = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    bare = raw.startswith("{") & raw.endswith("}")
    inner = ~bare & (first > 0) & raw.contains("}") & (last > first)
    return raw, fenced, F.when(inner, F.substring(raw, first, last - first + 1))


def recovered(raw: Column) -> Column:
    """Array with the first candidate that parses, as ``struct<stage, value>``;
    empty when none does."""
    names = ("whole", "fenced", "braces")
    tries = F.array(
        *[F.struct(F.lit(n).alias("stage"), c.alias("text")) for n, c in zip(names, json_candidates(raw))]
    )
    parsed = F.transform(tries, lambda t: F.struct(t["stage"].alias("stage"), strict_json(t["text"]).alias("value")))
    return F.slice(F.filter(parsed, lambda p: p["value"].isNotNull()), 1, 1)


def recover(responses: DataFrame, raw: str) -> DataFrame:
    """Add ``stage`` and the VARIANT ``value`` of each raw response, null if none.

    Unnesting the one-element result also keeps later filters from being pushed
    below the parse, where each would repeat it.
    """
    return (
        responses.withColumn("recovered", F.explode_outer(recovered(F.col(raw))))
        .withColumns({"stage": F.col("recovered.stage"), "value": F.col("recovered.value")})
        .drop("recovered")
    )


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def coerce_num(value: Column, path: str, default: float = 0.0) -> Column:
    """Number or default.  JSON null and blank text count as 0, a missing field
    as the default; text must be a plain decimal number."""
    item = field(value, path)
    kind = F.schema_of_variant(item)
    text = F.trim(F.try_variant_get(value, path, "string"))
    parsed = (
        F.when(item.isNull(), F.lit(None))
        .when(kind == "VOID", F.lit(0.0))
        .when(kind == "BOOLEAN", F.try_variant_get(value, path, "boolean").cast("int").cast("double"))
        .when(kind == "STRING", F.when(text == "", F.lit(0.0)).when(text.rlike(NUMBER_SHAPE), text.try_cast("double")))
        .otherwise(F.try_variant_get(value, path, "double"))
    )
    finite = F.when(~F.isnan(parsed) & (F.abs(parsed) < F.lit(float("inf"))), parsed)
    return F.coalesce(finite, F.lit(float(default)))


def coerce_str(value: Column, path: str, default: str = "") -> Column:
    """Text or default; numbers and booleans are not converted."""
    is_text = F.schema_of_variant(field(value, path)) == "STRING"
    return F.when(is_text, F.try_variant_get(value, path, "string")).otherwise(F.lit(default))
