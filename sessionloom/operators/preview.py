"""A bounded page of redacted messages per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.identity import redact_text
from sessionloom.functions.text import shorten

PAGE = 100
CUT = 2000
BLOCK = 1000


def page(
    messages: DataFrame,
    keys: Sequence[str],
    salt: bytes,
    offset: int = 0,
    limit: int = PAGE,
    usernames: Sequence[str] = (),
    stoplist: Sequence[str] = (),
) -> DataFrame:
    """Messages offset..offset+limit of each session, redacted, then cut.

    The row-number bound is applied on the map side, so a long session sends only
    its first rows. Only the page is redacted. Totals come from a plain count.
    """
    keys = list(keys)
    offset, limit = max(0, offset), max(1, min(limit, PAGE))
    numbered = messages.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    wanted = numbered.where((F.col("_n") <= offset + limit)).where(F.col("_n") > offset)
    sizes = messages.groupBy(*keys).agg(F.count("*").alias("total_messages"))
    redacted = wanted.withColumn("_r", redact_text(F.col("text"), salt, usernames, stoplist))
    shown = redacted.select(
        *keys, (F.col("_n") - 1).alias("position"), "role", shorten(F.col("_r.text"), CUT).alias("text"),
        (F.col("_r.secrets") + F.col("_r.identity")).alias("redaction_count"),
    )
    stop = F.least(F.lit(offset + limit), F.col("total_messages"))
    return shown.join(sizes, keys).withColumns({"next_offset": stop, "has_more": stop < F.col("total_messages")})


def rank_index(messages: DataFrame, keys: Sequence[str], span: int = BLOCK) -> DataFrame:
    """(keys, block, first, n, total_messages): where each stretch of `span` values of `seq` begins in its session.

    Counts combine before the shuffle; the running sum is over blocks, not messages."""
    keys = list(keys)
    blocks = messages.groupBy(*keys, F.floor(F.col("seq") / span).alias("block")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    return blocks.withColumns(
        {"first": F.sum("n").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "total_messages": F.sum("n").over(whole)}
    )


def deep_page(
    messages: DataFrame,
    keys: Sequence[str],
    salt: bytes,
    offset: int = 0,
    limit: int = PAGE,
    usernames: Sequence[str] = (),
    stoplist: Sequence[str] = (),
    index: DataFrame | None = None,
    span: int = BLOCK,
) -> DataFrame:
    """As `page`, for any offset: only messages of the blocks that the page meets are sent and numbered.

    A session has at most a few such blocks, so none is sorted as a whole however long it is. An `index` kept from
    an earlier page saves the count; it has to be of the same messages and span. Rows of one `seq` are ordered by role and text.
    A session that ends before the offset gives one row with its total and no message.
    """
    keys = list(keys)
    offset, limit = max(0, offset), max(1, min(limit, PAGE))
    known = index if index is not None else rank_index(messages, keys, span)
    met = known.where((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset))
    sent = messages.withColumn("block", F.floor(F.col("seq") / span)).join(met.select(*keys, "block", "first"), [*keys, "block"])
    inside = Window.partitionBy(*keys, "block").orderBy("seq", "role", "text")
    numbered = sent.withColumn("position", F.col("first") + F.row_number().over(inside) - 1)
    wanted = numbered.where((F.col("position") >= offset) & (F.col("position") < offset + limit))
    redacted = wanted.withColumn("_r", redact_text(F.col("text"), salt, usernames, stoplist))
    shown = redacted.select(
        *keys, "position", "role", shorten(F.col("_r.text"), CUT).alias("text"), (F.col("_r.secrets") + F.col("_r.identity")).alias("redaction_count")
    )
    # The row of each session that holds its total is its first block; sessions that end too early are known from it.
    sizes = known.where("first = 0").select(*keys, "total_messages")
    past = sizes.where(F.col("total_messages") <= offset)
    rows = shown.join(sizes, keys).unionByName(past, allowMissingColumns=True)
    stop: Column = F.least(F.lit(offset + limit), F.col("total_messages"))
    return rows.withColumns({"next_offset": stop, "has_more": stop < F.col("total_messages")})
