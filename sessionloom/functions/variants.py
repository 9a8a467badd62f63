"""Reading loosely shaped JSON held as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# A string may be as long as a row; the parser's own limit is 20,000,000 characters.
_PARSER = {"maxStringLen": "2147483647"}
_LAST = 918273645546372819


def documents(text: Column) -> Column:
    """The JSON value that the text is, as a list of one; NULL where it is none.

    Read as the first of two elements of a list: a second value, a bracket or other junk behind the text leaves
    another number of elements or another last one.
    """
    listed = F.concat(F.lit("["), text, F.lit(f",{_LAST}]"))
    elements = F.try_variant_get(F.from_json(listed, "variant", _PARSER), "$", "array<variant>")
    whole = lambda found: (F.size(found) == 2) & (F.try_variant_get(F.get(found, F.lit(1)), "$", "bigint") == _LAST)
    return F.element_at(F.transform(F.array(elements), lambda found: F.when(whole(found), F.slice(found, 1, 1))), 1)


def document(text: Column) -> Column:
    """The JSON value that the text is, or NULL."""
    return F.get(documents(text), F.lit(0))


def field(value: Column, path: str) -> Column:
    """The field as VARIANT; SQL NULL when it is absent."""
    return F.try_variant_get(value, path, "variant")


def is_null(value: Column) -> Column:
    """The JSON literal null, as opposed to an absent field."""
    return F.coalesce(F.is_variant_null(value), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def string(value: Column, path: str) -> Column:
    """The field when it is a JSON string, otherwise NULL."""
    found = field(value, path)
    return F.when(is_string(found), found.cast("string"))


def shown(value: Column) -> Column:
    """A scalar as the text Python's str() gives; nested values as compact JSON."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(is_null(value), F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(value.cast("string")))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value))
        .otherwise(value.cast("string"))
    )


def items(value: Column, path: str) -> Column:
    """The elements of an array field; NULL when the field is no array."""
    return F.try_variant_get(value, path, "array<variant>")


def content_text(value: Column, path: str, block: Callable[[Column], Column], keep_empty: bool = True) -> Column:
    """Message content as text: block texts joined by line breaks, a string as it is.

    `block` gives the text of one element or NULL to leave it out. The array test
    comes first because naming the type of a value walks all of it.
    """
    whole = field(value, path)
    parts = F.array_compact(F.transform(items(value, path), block))
    if not keep_empty:
        parts = F.filter(parts, lambda part: part != "")
    return (
        F.when(whole.isNull(), F.lit(""))
        .when(items(value, path).isNotNull(), F.array_join(parts, "\n"))
        .when(is_string(whole), whole.cast("string"))
        .otherwise(shown(whole))
    )
