"""Reading irregular JSON with VARIANT: one parse per document, fields by cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END = "~end-of-document~"


# Where a document is found in what ``documents`` returns.
ROOT = "$[0]"


def documents(text: Column) -> Column:
    """The JSON document of a text in an array of one, to be exploded; NULL in it if the text is no JSON.

    The plain parser stops after the first value and ignores the rest. Here the
    text is wrapped in a list with an end mark behind it: leftovers break the
    list, so ``{"a":1} x`` is no JSON. The document itself is at ``ROOT``.

    Exploding keeps the parse below a generator. A filter on the result cannot
    be pushed into it, where it would parse the text again for every mention.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))
    return F.transform(F.array(parsed), lambda p: F.when(F.try_variant_get(p, "$[1]", "string") == END, p))


def value_at(value: Column, path: str) -> Column:
    """What is at a path; a variant null for a JSON null, NULL if there is nothing."""
    return F.try_variant_get(value, path, "variant")


def fields(value: Column, *names: str, path: str = "$") -> Column:
    """Fields of the object at a path as a struct of variants; NULL if there is no object.

    A missing field is NULL, a JSON null is a variant null.
    """
    return F.try_variant_get(value, path, "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def elements(value: Column, path: str = "$") -> Column:
    """Items of the JSON array at a path; NULL if there is no array."""
    return F.try_variant_get(value, path, "array<variant>")


def text(value: Column) -> Column:
    return value.cast("string")


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_nested(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")


def json_text(value: Column) -> Column:
    """Compact JSON text."""
    return F.to_json(value)


# How JSON writes the values that count as absent.
FALSY = ("null", '""', "0", "false", "[]", "{}")


def is_truthy(value: Column) -> Column:
    return F.coalesce(~json_text(value).isin(*FALSY), F.lit(False))
