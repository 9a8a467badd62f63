"""Places in a global order as a column, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# monotonically_increasing_id keeps the partition above these bits and the row below them.
_ROW_BITS = 33


def numbered(rows: DataFrame, by: Sequence[Column], folder: str, name: str = "position") -> DataFrame:
    """Adds each row's place, from 0, in the order of `by`, which has to tell rows apart to be the same in every run.

    Rows are dealt to ranges of the order, sorted there, and written below `folder`, a new folder that all executors
    share, so that a row lost and read again keeps its place. The place is the row's number in its range plus the rows
    of the ranges before it: only one count per range is summed in order. Rows equal in `by` stay in one range; more of
    them than a task sorts are to be told apart by a further column. An empty table stays empty.
    """
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged.withColumn("_place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
    placed = rows.sparkSession.read.schema(ranged.schema.add("_place", "long")).parquet(folder)
    part = F.shiftright("_place", _ROW_BITS)
    keyed = placed.withColumn("_part", part).withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    counts = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per range: this window holds as many rows as the range shuffle has partitions.
    running = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    parts = counts.select("_part", running.alias("_before"))
    return keyed.join(parts, "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_place", "_before")
