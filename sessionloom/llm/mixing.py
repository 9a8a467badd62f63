"""Mixing sources to target weights by a temperature.

A source's weight is its share of tokens raised to an exponent, normalised. At exponent 1 the mix is the corpus, at 0
all sources weigh the same. The exponent is found by bisection: the largest one whose mix has at least the wanted
entropy, but never so small that a source is repeated more often than the limit. The budget in tokens is either given
or the least one at which every source is read once.

Weights become rows by block permutations. A source is cut into blocks by a hash of its rows; each pass over it is
another permutation of its blocks and of the rows in each block. Whole passes are taken while the budget lasts, and of
the last pass the first rows in that order, up to and including the row that meets the budget. Only block totals are
summed along a source; rows are numbered inside their block, so a source with a third of all rows is no single task.

Defined results: tokens are runs of characters other than white space; a row has at least one, so that rows without
text are dealt out too. Null is a source of its own. Repeated rows are rows of their own: they share a place and stand
in some order. Extra columns pass through untouched. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch, documents

BLOCK_ROWS, SEED = 512, 17


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))).cast("long")


def _weights(shares: list[float], exponent: float) -> list[float]:
    logs = [exponent * math.log(s) for s in shares]
    top = max(logs)
    raised = [math.exp(x - top) for x in logs]
    total = math.fsum(raised)
    return [x / total for x in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def repetition(shares: list[float], weights: list[float], whole: bool, size: float = 1.0) -> float:
    """Most passes over a source. `whole`: the budget is such that the source read least is read once."""
    rates = [w / s for w, s in zip(weights, shares, strict=True)]
    return max(rates) / min(rates) if whole else max(rates) * size


def exponent_for(shares: list[float], target_entropy: float | None, limit: float | None, whole: bool, size: float = 1.0) -> float:
    """Bisection on [0, 1]: entropy and repetition both grow as the exponent falls."""

    def least(reached) -> float:
        if reached(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if reached(middle) else (low, middle)
        return low

    wanted = 0.0 if target_entropy is None else least(lambda e: entropy(_weights(shares, e)) >= target_entropy)
    if limit is None:
        return wanted
    if repetition(shares, _weights(shares, 1.0), whole, size) > limit:
        return 1.0
    if repetition(shares, _weights(shares, 0.0), whole, size) <= limit:
        return wanted
    low, high = 0.0, 1.0  # the smallest exponent that keeps the limit
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if repetition(shares, _weights(shares, middle), whole, size) <= limit else (middle, high)
    return max(wanted, high)


def targets(totals: DataFrame, target_share: float | None, limit: float | None, budget: float | None) -> DataFrame:
    """(source, tokens, weight, goal) from (source, tokens). One row per source reaches the driver: its list of names,
    which the caller vouches to be short, as weights per source are settings of a run.

    `target_share`: how far the entropy is lifted from the corpus' own (0) to that of equal weights (1)."""
    rows = totals.orderBy("source").collect()
    total = sum(r["tokens"] for r in rows)
    if not total:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("goal"))
    shares = [r["tokens"] / total for r in rows]
    own = entropy(shares)
    wanted = None if target_share is None else own + target_share * (math.log(len(rows)) - own) - 1e-12
    whole = budget is None
    weights = _weights(shares, exponent_for(shares, wanted, limit, whole, 1.0 if whole else budget / total))
    size = budget if budget is not None else max(r["tokens"] / w for r, w in zip(rows, weights, strict=True))
    goals = [max(round(size * w), r["tokens"] if whole else 0) for r, w in zip(rows, weights, strict=True)]
    return totals.sparkSession.createDataFrame(
        [(r["source"], r["tokens"], w, g) for r, w, g in zip(rows, weights, goals, strict=True)], "source string, tokens long, weight double, goal long"
    )


def mix(
    docs: DataFrame, source: Column, text: Column, scratch: Scratch, target_share: float | None = 0.5, limit: float | None = 2.0,
    budget: float | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED,
) -> DataFrame:
    """(row, source, tokens, pass, block, place): the mixed rows; `pass`, the order of blocks and `place` give their order."""
    whole = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c, kind in docs.dtypes if not kind.startswith(("map", "binary"))])
    keyed = docs.select(F.struct("*").alias("row"), source.cast("string").alias("source"), token_count(text).alias("tokens"), whole.alias("key"))
    narrow = scratch.keep(keyed.select("source", "key", "tokens"), "narrow")
    totals = narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    goals = targets(totals, target_share, limit, budget).join(
        totals.select(F.col("source").alias("s"), F.ceil(F.col("n") / block_rows).alias("blocks")), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    block = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks"))
    goals = scratch.keep(
        goals.select(F.col("source").alias("s"), "blocks", "goal", F.col("tokens").alias("own"), F.floor(F.col("goal") / F.col("tokens")).cast("int").alias("full")), "goals"
    )
    met = F.col("source").eqNullSafe(F.col("s"))
    # The last, unfinished pass: where each block begins in its permutation.
    rest = (F.col("goal") - F.col("full") * F.col("own")).alias("rest")
    part = narrow.join(goals, met).where(F.col("goal") > F.col("full") * F.col("own")).select("source", "key", "tokens", block.alias("block"), "full", rest)
    sums = part.groupBy("source", "block", "full", "rest").agg(F.sum("tokens").alias("t"))
    begins = sums.select(
        F.col("source").alias("bs"), F.col("block").alias("bb"), "rest",
        F.expr(f"sum(t) OVER (PARTITION BY source ORDER BY xxhash64(block, full, {seed}), block) - t").alias("begin"), "t",
    ).where(F.col("begin") < F.col("rest"))
    inside = part.drop("rest").join(begins, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")))
    # Blocks that end before the goal are taken whole; of the block that holds it, equal keys stand together.
    cut = inside.where(F.col("begin") + F.col("t") > F.col("rest")).groupBy("source", "block", "full", "rest", "begin", "key").agg(
        F.sum("tokens").alias("of_key"), F.max("tokens").alias("each"), F.count("*").alias("copies")
    ).withColumn("before", F.expr(f"sum(of_key) OVER (PARTITION BY source, block ORDER BY xxhash64(key, full, {seed}), key) - of_key") + F.col("begin"))
    last = cut.where(F.col("before") < F.col("rest")).select("key", F.least("copies", F.ceil((F.col("rest") - F.col("before")) / F.col("each"))).alias("take"))
    # Bring the decisions to the rows.
    dealt = keyed.join(goals, met).withColumn("block", block)
    blocks = begins.select("bs", "bb", F.when(F.col("begin") + F.col("t") <= F.col("rest"), F.lit(True)).otherwise(False).alias("whole"))
    dealt = dealt.join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")), "left")
    plain = dealt.where("whole IS NULL OR whole").withColumn("passes", F.col("full") + F.when(F.col("whole"), 1).otherwise(0))
    edge = dealt.where("NOT whole").join(last, "key", "left")
    edge = edge.withColumn("nth", F.expr("row_number() OVER (PARTITION BY source, key ORDER BY tokens)")).withColumn(
        "passes", F.col("full") + F.when(F.col("nth") <= F.coalesce("take", F.lit(0)), 1).otherwise(0)
    )
    out = ["row", "source", "tokens", "key", "block", "passes"]
    chosen = plain.select(out).unionByName(edge.select(out)).where("passes > 0")
    return chosen.select("row", "source", "tokens", "block", "key", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass")).withColumn(
        "place", F.xxhash64("key", "pass", F.lit(seed))
    ).drop("key")


def op4_mixing(spark, folder: str) -> DataFrame:
    """Each document with its passes in a mix lifted half way to equal sources, at most two passes over any."""
    docs = documents(spark, folder).select("doc_id", "source", "text")
    mixed = mix(docs, F.col("source"), F.col("text"), Scratch(spark, "mixing"))
    return mixed.select("row.doc_id", "source", "tokens", "pass", "block", "place")
