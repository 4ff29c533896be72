"""Model replies: tolerant parsing and the spans they name, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.intervals import SPAN, span


def parsed(text: Column) -> Column:
    """The reply as a variant; null where the whole text is not one JSON value (the parser alone stops after the first)."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(alone, "$[1]", "variant").isNull(), F.try_variant_get(alone, "$[0]", "variant"))


def field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def kind_of(v: Column) -> Column:
    """``object``, ``array``, ``number``, ``string``, ``boolean`` or null (absent or JSON null) of a variant."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), None)
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def predicted_spans(v: Column) -> Column:
    """The spans of ``evidence_seconds``, whatever its shape: a number or a list of one is a point; of more numbers
    (others are passed over) the hull; objects with start and end are spans as they are; an empty or zero value is none."""
    es = F.try_variant_get(v, "$.evidence_seconds", "variant")
    none = F.array().cast(f"array<{SPAN}>")
    items = F.try_variant_get(es, "$", "array<variant>")
    objects = F.forall(items, lambda x: kind_of(x) == "object")
    of_objects = F.filter(
        F.transform(items, lambda x: span(F.try_variant_get(x, "$.start", "double"), F.try_variant_get(x, "$.end", "double"))),
        lambda x: x["start"].isNotNull() & x["end"].isNotNull(),
    )
    numbers = F.filter(F.transform(items, lambda x: F.when(kind_of(x).isin("number", "string"), F.try_variant_get(x, "$", "double"))), lambda x: x.isNotNull())
    hull = F.when(F.size(numbers) > 0, F.array(span(F.array_min(numbers), F.array_max(numbers)))).otherwise(none)
    one = F.try_variant_get(es, "$", "double")
    single = span(F.try_variant_get(es, "$.start", "double"), F.try_variant_get(es, "$.end", "double"))
    return (
        F.when(kind_of(es) == "array", F.when(F.coalesce(objects, F.lit(False)), of_objects).otherwise(hull))
        .when(kind_of(es) == "object", F.when(single["start"].isNotNull() & single["end"].isNotNull(), F.array(single)).otherwise(none))
        .when((kind_of(es) == "number") & (one != 0), F.array(span(one, one)))
        .otherwise(none)
    )


def list_spans(v: Column) -> Column:
    """The strict reading: only a list of numbers; one number is a point, of more the hull."""
    es = F.try_variant_get(v, "$.evidence_seconds", "variant")
    items = F.try_variant_get(es, "$", "array<variant>")
    numbers = F.transform(items, lambda x: F.when(kind_of(x) == "number", F.try_variant_get(x, "$", "double")))
    whole = (F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), F.array(span(F.array_min(numbers), F.array_max(numbers)))).otherwise(F.array().cast(f"array<{SPAN}>"))


def normal_answer(c: Column) -> Column:
    return F.upper(F.trim(c))


def model_json(response: Column) -> Column:
    """struct(json, error) of a raw reply: code fences removed, from the first brace to the last, parsed.

    error: ``empty`` for null, ``no_object`` without braces, ``invalid`` where what stands between them is no JSON object.
    """
    bare = F.regexp_replace(F.trim(response), "(?m)^```(?:json)?|```$", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = kind_of(F.try_parse_json(body)) == "object"
    return F.struct(
        F.when(ok, body).alias("json"),
        F.when(response.isNull(), "empty").when(body == "", "no_object").when(~F.coalesce(ok, F.lit(False)), "invalid").alias("error"),
    )


def condition_for_alpha(alpha: Column) -> Column:
    return F.when(alpha >= 1, "C1").when(alpha <= 0, "C3").when(alpha.isNotNull(), "C2")


def alpha_tag(alpha: Column) -> Column:
    """``a005`` for 0.05: hundredths, rounded half to even."""
    return F.format_string("a%03d", F.bround(alpha * 100).cast("int"))
