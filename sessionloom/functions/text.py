"""String and array expressions shared by all jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The same set as the inside of a Java character class.
WHITESPACE_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0  -     　"
# Line boundaries of str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
OTHER_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

EMPTY_SESSION = "(empty session)"
FIRST_MESSAGE_LENGTH = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it any number of times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def unify_line_breaks(text: Column) -> Column:
    """Every line boundary as a line feed; most texts have no other and stay as they are."""
    other = F.lit(False)
    for mark in OTHER_LINE_BREAKS:
        other = other | text.contains(mark)
    return F.when(other, F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)


def truncate(text: Column, length: int = FIRST_MESSAGE_LENGTH) -> Column:
    """Stripped text cut to `length` code points, with dots only when something was cut."""
    return shorten(strip(text), length)


def shorten(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def collapse_whitespace(text: Column) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(text, f"[{WHITESPACE_CLASS}]+", " "))


def human_size(size: Column) -> Column:
    """Bytes in steps of 1024 with one decimal, up to TB."""
    amount = size.cast("double")
    result = F.format_string("%.1f TB", amount / F.lit(1024.0**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        scaled = amount / F.lit(1024.0**power)
        result = F.when(scaled < 1024, F.format_string(f"%.1f {unit}", scaled)).otherwise(result)
    return result


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def path_suffix(path: Column) -> Column:
    """Extension with its dot; a leading or trailing dot alone is no extension."""
    return F.regexp_extract(path_name(path), r"[^/](\.[^./]+)$", 1)


def path_stem(path: Column) -> Column:
    name = path_name(path)
    return F.left(name, F.length(name) - F.length(path_suffix(path)))


def iso_utc(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss 'UTC'")


def exclusive_scan(values: Column, zero: int, combine: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """For each element of a BIGINT array, the combination of everything before it.

    `combine` must be associative. Elements are scanned in chunks and the chunk
    totals are scanned again, so cost stays close to linear on very long arrays
    although each array_append copies.
    """
    start = F.struct(F.lit(zero).cast("bigint").alias("acc"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, value: Column) -> Column:
        return F.struct(
            combine(state["acc"], value).cast("bigint").alias("acc"),
            F.array_append(state["out"], state["acc"]).alias("out"),
        )

    def scan(array: Column) -> Column:
        return F.aggregate(array, start, step)

    last = F.greatest(F.floor((F.size(values) - 1) / F.lit(chunk)).cast("int"), F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: scan(F.slice(values, i * chunk + 1, F.lit(chunk))))
    return let(
        pieces,
        lambda scanned: F.flatten(
            F.zip_with(
                scanned,
                scan(F.transform(scanned, lambda s: s["acc"]))["out"],
                lambda s, base: F.transform(s["out"], lambda v: combine(base, v).cast("bigint")),
            )
        ),
    )
