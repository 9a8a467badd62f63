"""Places in a global order, and statuses in the order of their requests."""

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import projects as P
from sessionloom.operators import status as st
from sessionloom.operators.order import numbered


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_are_those_of_a_sorted_list(spark, tmp_path, partitions):
    values = [(i * 7919) % 1000 for i in range(1500)] + [None] * 3
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(partitions)
    got = numbered(rows, [F.col("v").asc_nulls_last(), F.col("i")], str(tmp_path / "places")).orderBy("position").collect()
    expected = sorted(((v, i) for i, v in enumerate(values)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.v, r.i) for r in got] == expected
    assert [r.position for r in got] == list(range(len(values)))


def test_equal_rows_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)], "v string")
    got = numbered(rows, [F.col("v")], str(tmp_path / "equal")).collect()
    assert sorted(r.position for r in got) == list(range(6)) and {r.position for r in got if r.v == "b"} == {5}
    empty = numbered(rows.limit(0), [F.col("v")], str(tmp_path / "empty"))
    assert empty.columns == ["v", "position"] and empty.count() == 0


REF = "source string, project_id string, parent string, id string"


def test_checked_statuses_come_before_cached_ones(spark, tmp_path):
    requests = spark.createDataFrame([("codex", "p", None, x, i) for i, x in enumerate("dcbad")], f"{REF}, ordinal int")

    def statuses(*rows):
        return spark.createDataFrame([("codex", "p", parent, x, state) for parent, x, state in rows], f"{REF}, state string")

    cached, checked = statuses((None, "a", "current"), ("", "d", "current"), ("q", "b", "current")), statuses((None, "a", "changed"), (None, "c", "error"), (None, "z", "error"))
    got = st.in_request_order(requests, cached, checked, [F.col("ordinal")], str(tmp_path / "order")).orderBy("position").collect()
    # b was saved for another parent only, z was not asked for, and d was asked for twice.
    assert [(r.id, r.state, r.cached) for r in got] == [("d", "current", True), ("c", "error", False), ("a", "changed", False), ("d", "current", True)]
    assert [r.position for r in got] == [0, 1, 2, 3]


def test_projects_newest_first_then_by_label(spark, tmp_path):
    rows = [("1", "beta", None, 5), ("2", "Alpha", "/x", 5), ("3", "alpha", "/a", 5), ("4", "new", None, 9), ("5", "never", None, None)]
    listed = spark.createDataFrame(rows, "identity string, label string, directory string, t long").withColumn("latest_modified", F.timestamp_seconds("t"))
    got = P.ordered_projects(listed, str(tmp_path / "projects")).orderBy("position").collect()
    assert [r.identity for r in got] == ["4", "3", "2", "1", "5"]
