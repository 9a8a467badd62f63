"""Merging spans that are held as rows rather than inside their text's row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Spans starting within this many positions share a window; the rest is carried over.
STRETCH = 1 << 20


def merge_span_rows(spans: DataFrame, keys: Sequence[str], stretch: int = STRETCH) -> DataFrame:
    """Overlapping spans per key become one; touching spans stay apart.

    `spans` has the keys, start, stop, ord, kind and rank. The kind of the highest
    rank survives, the earlier span winning ties. A key is worked on in stretches
    of its positions, so no window holds a whole key: a stretch gets the furthest
    stop of all stretches before it, and later the number of islands before it.
    """
    keys = list(keys)
    piece = [*keys, "_stretch"]
    cut = spans.withColumn("_stretch", F.floor(F.col("start") / stretch))
    across = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*piece).agg(F.max("stop").alias("_furthest"))
        .select(*piece, F.max("_furthest").over(across).alias("_carried"))
    )
    ordered = Window.partitionBy(*piece).orderBy("start", F.col("stop").desc(), "ord", "kind", "rank")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    opened = (
        cut.join(carried, piece)
        .withColumn("_reach", F.greatest(F.max("stop").over(before), F.col("_carried")))
        .withColumn("_opens", (F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))).cast("bigint"))
        .withColumn("_local", F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.row_number().over(ordered))
    )
    islands_before = (
        opened.groupBy(*piece).agg(F.sum("_opens").alias("_opened"))
        .select(*piece, F.coalesce(F.sum("_opened").over(across), F.lit(0)).alias("_before"))
    )
    numbered = opened.join(islands_before, piece).withColumn("_island", F.col("_before") + F.col("_local"))
    best = F.struct("rank", (-F.col("_stretch")).alias("s"), (-F.col("_n")).alias("n"))
    merged = numbered.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.max_by("kind", best).alias("kind")
    )
    return merged.select(*keys, "start", "stop", "kind", (F.col("stop") - F.col("start")).alias("original_length"))
