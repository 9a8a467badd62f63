"""Pages at any offset against slices of a sorted list."""

import random

import pytest

from sessionloom.operators.preview import deep_page, rank_index

SALT = bytes(16)


@pytest.fixture(scope="module")
def talk(spark):
    draw = random.Random(7)
    rows = [("long", 3 * k + draw.randint(0, 2), "user", f"text {k}") for k in range(700)]
    rows += [("short", k * 10_000, "user", f"s {k}") for k in range(3)] + [("ties", 5, r, t) for r in ("assistant", "user") for t in "ab"]
    return spark.createDataFrame(rows, "session string, seq bigint, role string, text string").repartition(5)


@pytest.mark.parametrize(("offset", "span"), [(0, 50), (2, 50), (149, 7), (650, 100_000), (699, 1), (5000, 50)])
def test_pages_are_slices(spark, talk, offset, span):
    known = {}
    for r in talk.collect():
        known.setdefault(r.session, []).append((r.seq, r.role, r.text))
    found = {}
    for r in deep_page(talk, ["session"], SALT, offset, 10, span=span, index=rank_index(talk, ["session"], span)).collect():
        found.setdefault(r.session, []).append(r)
    for session, rows in known.items():
        want = [(offset + k, role, text) for k, (_, role, text) in enumerate(sorted(rows)[offset : offset + 10])]
        got = sorted((r.position, r.role, r.text) for r in found[session] if r.position is not None)
        assert got == want and all(r.total_messages == len(rows) for r in found[session])
        assert len(found[session]) == max(1, len(want))  # past the end the total remains
        assert all(r.next_offset == min(offset + 10, len(rows)) and r.has_more == (offset + 10 < len(rows)) for r in found[session])


def test_a_page_sends_few_rows(spark, talk):
    plan = deep_page(talk, ["session"], SALT, 300, 10, span=50)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "row_number" in plan
    assert deep_page(talk.limit(0), ["session"], SALT).count() == 0
