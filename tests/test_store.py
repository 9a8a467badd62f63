"""Keyed tables against a dictionary: changes, removals, compaction, repeated and interrupted versions."""

import random

import pytest

from sessionloom.sources.store import KeyedTable

SCHEMA = "k string, part string, v int"


def rows(spark, values):
    return spark.createDataFrame([(k, p, v) for (k, p), v in values.items()], SCHEMA)


def held(table, before=None):
    got = table.read(before).collect()
    found = {(r.k, r.part): r.v for r in got}
    assert len(found) == len(got)
    return found


def test_random_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeyedTable, "MOST_WAITING", 2)
    draw, table, known = random.Random(3), KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "part"], buckets=3), {}
    past = {}
    for version in range(5):
        n = 60 if not version else draw.choice((0, 1, 2, 30))
        fresh = {(f"k{draw.randint(0, 80)}", draw.choice((None, "p"))): draw.randint(0, 9) for _ in range(n)}
        gone = draw.sample(sorted(set(known) - set(fresh), key=str), 3) if version % 2 else []
        removed = spark.createDataFrame(gone, "k string, part string") if gone else None
        table.upsert(rows(spark, fresh), version, removed)
        known = {k: v for k, v in (known | fresh).items() if k not in gone}
        past[version] = dict(known)
        assert held(table) == known
        assert held(table, before=version) == past.get(version - 1, {})
        head = table.head()
        assert len(head.changes) <= 2 and sum(head.rows.values()) + sum(head.later.values()) >= len(known)


def test_a_small_change_writes_little(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)
    assert table.upsert(rows(spark, {(f"k{i}", "p"): i for i in range(400)}), 0).written == 400
    assert table.upsert(rows(spark, {("k7", "q"): 1, ("new", "q"): 2}), 1).written == 2
    assert table.upsert(rows(spark, {}), 2).written == 0
    assert len(held(table)) == 401 and held(table)["k7", "q"] == 1
    # A bucket of which more than a quarter has changed is written whole, the others are not.
    many = {(f"k{i}", "r"): 0 for i in range(400)}
    head = table.upsert(rows(spark, many), 3)
    assert head.written == 400 + 401 and set(head.base.values()) == {3} and not head.changes
    assert held(table) == many | {("new", "q"): 2}


def test_a_version_may_be_written_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=2)
    table.upsert(rows(spark, {("a", None): 1, ("b", None): 1}), 0)
    table.upsert(rows(spark, {("a", None): 2}), 1)
    for value in (3, 4):
        table.upsert(rows(spark, {("a", None): value, ("c", None): value}), 2)
        assert held(table) == {("a", None): value, ("b", None): 1, ("c", None): value}
    # Rows without a head, as a run that was ended leaves them, are not seen.
    table._write("changes", 3, rows(spark, {("z", None): 9}).selectExpr("*", "false AS _gone", "0 AS bucket"))
    assert ("z", None) not in held(table) and held(table, before=3) == held(table)


def test_an_empty_table_and_other_columns(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    assert held(table) == {} and table.head() is None
    table.upsert(rows(spark, {}), 0)
    assert held(table) == {}
    table.upsert(rows(spark, {("a", "b"): 1}), 1)
    assert held(table) == {("a", "b"): 1}
    with pytest.raises(ValueError, match="other columns"):
        KeyedTable(spark, str(tmp_path / "t"), "k string, w int", ["k"]).read()
