"""Row-wise span merge."""

import random

from sessionloom.operators.spans import merge_span_rows

SCHEMA = "doc string, start bigint, stop bigint, ord int, kind string, rank int"


def test_fixed_example(spark):
    rows = [
        ("d", 0, 40, 0, "openai", 10), ("d", 0, 40, 1, "anthropic", 30), ("d", 40, 50, 2, "generic", 5),
        ("d", 60, 90, 3, "uri_userinfo", 20), ("d", 70, 80, 4, "neon", 25),
    ]
    got = merge_span_rows(spark.createDataFrame(rows, SCHEMA), ["doc"]).orderBy("start").collect()
    assert [(r.start, r.stop, r.kind) for r in got] == [(0, 40, "anthropic"), (40, 50, "generic"), (60, 90, "neon")]


def test_stretches_do_not_change_the_result(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        start = rng.randint(0, 2000)
        rows.append((rng.choice(["hot", "hot", "hot", "b"]), start, start + rng.choice([1, 3, 9, 70]), rng.randint(0, 3), rng.choice("xyz"), rng.choice([5, 10])))
    rows = list(set(rows))
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, merge_span_rows(frame, ["doc"]).collect()))
    for stretch in (7, 64, 500):
        assert sorted(map(tuple, merge_span_rows(frame, ["doc"], stretch).collect())) == whole
