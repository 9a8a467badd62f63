"""Joins from rows without a key: they are dealt to all tasks, whatever the planner makes of the condition."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom.operators.joins import lookup
from sessionloom.operators.launch import inherit_launch_kind


@pytest.fixture()
def plain_joins(spark):
    """Shuffles as planned: no broadcast and no change at run time."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, ("false", "-1"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def unlinked(spark):
    """4,000 sessions without a parent, in columns that the planner can't take for constants."""
    number = F.col("id")
    return spark.range(4000).select(
        number.cast("string").alias("id"), F.when(number >= 0, "codex").alias("source"),
        F.when(number < 0, "p").alias("parent"), F.when(number >= 0, "human").alias("own_kind"),
    )


def largest_share(rows):
    # Collected as they are: an aggregate on top would let the planner leave the join out.
    parts = Counter(r.part for r in rows.withColumn("part", F.spark_partition_id()).collect())
    return max(parts.values()) / parts.total()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_the_right_side_is_found(spark, plain_joins, how):
    left = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 3), ("b", "y", 4)], "k string, l string, n int")
    right = spark.createDataFrame([("a", "x", 10), (None, "x", 20), ("a", None, 30)], "k string, l string, v int")
    found = {(r.n, r.v) for r in lookup(left, right, ["k", "l"], ["n"], how).collect()}
    assert found == ({(1, 10)} if how == "inner" else {(1, 10), (2, None), (3, None), (4, None)})


def test_rows_without_a_key_are_spread(spark, plain_joins):
    left = unlinked(spark).drop("own_kind")
    right = left.groupBy("source", F.col("id").alias("parent")).agg(F.count("*").alias("v"))
    assert largest_share(lookup(left, right, ["source", "parent"], ["id"])) < 0.5


def test_sessions_without_a_parent_are_spread(spark, plain_joins):
    labelled = inherit_launch_kind(unlinked(spark))
    assert largest_share(labelled) < 0.5
    assert labelled.where("launch_kind = 'human'").count() == 4000
