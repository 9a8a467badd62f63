"""Connected components by alternating star contraction, with edges kept in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch


ROWS_PER_TASK = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: neighbours above a node move to its least neighbour. Small: the others do.

    Minima combine before the shuffle; a hub's edges meet its minimum in a plain join, which can be split."""
    pairs = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x in "ab" for y in "ab"]
    both = edges.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v").where(F.lit(large) | (F.col("v") <= F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    joined = both.join(least, F.col("u") == F.col("k")).where(F.lit(not large) | (F.col("v") > F.col("u")))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label) for every node of `edges` (a, b); label is the least node that can be reached.

    The number of rounds grows with the logarithm of the longest path. No edge and no node reaches the driver, only
    a count and a checksum per round. The count sets the number of tasks, so a few edges are no hundreds of tasks."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = scratch.keep(edges, f"{name}-edges")
    state, step = edges.agg(F.count("*"), F.lit(None)).first(), 0
    while state[0]:
        if state[0] <= ROWS_PER_TASK:
            edges = edges.coalesce(1)
        edges = scratch.keep(_star(_star(edges, True), False), f"{name}-{step}")
        seen, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == seen:
            break
        step += 1
    nodes = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("label")), F.struct(F.col("b").alias("id"), F.col("b").alias("label"))))
    return edges.select(nodes.alias("n")).select("n.*").distinct()
