"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "left") -> DataFrame:
    """Join a skewed left side to a right side that is unique on `on`.

    Left rows with a NULL key match nothing and are spread over all partitions by a hash of `spread_by`, so retried
    tasks route every row as before. Nothing is repeated: a key with a large share of the left rows is split at run
    time by adaptive execution, which may cut the left side of these joins, and a right side that turns out small is
    broadcast. Results keep no partitioning that a later step could rely on.
    """
    keys = list(on)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    zero = F.lit(0).cast("bigint")
    spread = left.withColumn("_spread", F.when(no_key, F.xxhash64(*spread_by)).otherwise(zero))
    # A zero that is computed: a constant would be moved into a condition on the left side alone, and rows without a key dealt to one task.
    same_spread = F.xxhash64(*keys).bitwiseAND(zero)
    return spread.join(right.withColumn("_spread", same_spread), [*keys, "_spread"], how).drop("_spread")


def same(left: Column, right: Column) -> Column:
    """Equality that holds for two absent values."""
    return left.eqNullSafe(right)

