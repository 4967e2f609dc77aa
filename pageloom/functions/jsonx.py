"""JSON held in text: cleaning model replies, reading tags, flattening summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import non_empty, strip


def _without_fences(raw: Column) -> Column:
    bare = F.replace(F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return strip(bare)


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else.

    The parser stops behind the first value. A text that parses both as the only item of an array
    and as the value of an object can have nothing behind its value.
    """
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(as_field.isNotNull(), F.try_variant_get(as_item, "$[0]", "variant"))


def clean_json(raw: Column) -> Column:
    """VARIANT of a reply that is JSON, fenced JSON, or chatter around one object; else null."""
    text = _without_fences(raw)
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(strict_json(text), strict_json(non_empty(span)))


def is_filled_object(value: Column) -> Column:
    """True for an object with at least one key."""
    shape = F.schema_of_variant(value)
    return F.coalesce(shape.startswith("OBJECT<") & (shape != "OBJECT<>"), F.lit(False))


def _as_text(value: Column) -> Column:
    text = value.cast("string")
    return (
        F.when(value.isNull() | F.is_variant_null(value), "None")
        .when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def flatten_summary(value: Column, old: Column) -> Column:
    """Summary as one string: lists and object values are joined by a space, empty keeps ``old``."""
    shape = F.schema_of_variant(value)
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), _as_text)
    values = F.transform(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), _as_text)
    text = value.cast("string")
    joined = (
        F.when(shape.startswith("ARRAY<"), F.array_join(items, " "))
        .when(shape.startswith("OBJECT<"), F.array_join(values, " "))
        .when(shape == "VOID", F.lit(None).cast("string"))
        .when(shape == "BOOLEAN", F.when(text == "true", F.lit("True")))
        .when(shape == "STRING", text)
        .otherwise(F.when(text.try_cast("double") != 0, text))
    )
    empty = shape.isin("OBJECT<>") | (shape.startswith("ARRAY<") & (F.size(items) == 0))
    return F.coalesce(F.when(~empty, non_empty(joined)), old)


def parse_tags(raw: Column) -> Column:
    """Tags from the text of a list, with either kind of quotes; anything else is the empty list."""
    parsed = F.from_json(raw, "array<string>", {"allowSingleQuotes": "true"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


def tags_text(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def content_json(scraped_at: Column) -> Column:
    """Document stored with an article: when it was read and what was extracted."""
    fields = ("title", "author", "published_date", "clean_text", "main_image", "summary")
    return F.to_json(
        F.struct(
            F.date_format(scraped_at, "yyyy-MM-dd'T'HH:mm:ss").alias("scraped_at"),
            F.struct(*[F.col(f) for f in fields]).alias("raw_metadata"),
        ),
        {"ignoreNullFields": "false"},
    )
