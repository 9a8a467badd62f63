"""Status decisions, saved state, bundles, trajectories and preview pages."""

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import package, preview
from sessionloom.operators import status as st
from sessionloom.operators import trajectory as T
from sessionloom.sources.store import BatchTable, VersionedTable, current_bundles

REF = "source string, project_id string, parent string, id string, path string, key string, children_digest string"
HASH = "path string, source_hash string, file_snapshot string, error string"
GOOD = {"source-hash": "h", "source-hash-version": "5", "redaction-version": "1", "mts-manifest-version": "7"}


def refs(spark, *ids):
    return spark.createDataFrame([("codex", "p", None, i, f"/{i}", f"k/{i}", None) for i in ids], REF)


@pytest.mark.parametrize(
    "metadata, expected",
    [
        (None, "not_uploaded"), (GOOD, "current"), (GOOD | {"redaction-version": "0"}, "changed"), (GOOD | {"source-hash": "x"}, "changed"),
        ({"content-fingerprint": "h", "fingerprint-version": "5", "redaction-version": "1", "mts-manifest-version": "7"}, "current"),
        ({k: v for k, v in GOOD.items() if k != "mts-manifest-version"}, "changed"), ({}, "changed"),
    ],
)
def test_classification(spark, metadata, expected):
    objects = spark.createDataFrame([("k/a", metadata)] if metadata is not None else [], "key string, metadata map<string,string>")
    hashes = spark.createDataFrame([("/a", "h", "s", None)], HASH)
    row = st.classify(refs(spark, "a"), objects.withColumn("last_modified", F.lit(None)), hashes).first()
    assert row.state == expected and row.error is None
    assert (row.source_hash is None) == (expected == "not_uploaded")


def test_unreadable_transcripts_are_error_rows(spark):
    objects = spark.createDataFrame([("k/a", GOOD), ("k/b", GOOD), ("k/c", GOOD)], "key string, metadata map<string,string>")
    hashes = spark.createDataFrame([("/a", None, None, "OSError: x"), ("/c", "h", "s", None)], HASH)
    got = {r.id: (r.state, r.error) for r in st.classify(refs(spark, "a", "b", "c"), objects, hashes).collect()}
    assert got == {"a": ("error", "OSError: x"), "b": ("error", "No hash: the file changed while it was read"), "c": ("current", None)}


@pytest.mark.parametrize(
    "states, expected", [(["current"], "ready"), (["current", "error"], "partial"), (["error"], "failed"), ([], "ready")]
)
def test_summary_status(spark, states, expected):
    rows = [(s, "e" if s == "error" else None, None, False) for s in states]
    frame = spark.createDataFrame(rows, "state string, error string, source_hash string, cached boolean")
    assert st.refresh_summary(frame).first().status == expected


def test_state_roundtrip_and_publication(spark):
    base = refs(spark, "a", "b").withColumns({"state": F.lit("changed"), "source_hash": F.lit("h"), "file_snapshot": F.lit("s"), "error": F.lit("old")})
    state = st.as_state(base, "me")
    assert set(state.columns) == {c.split()[0] for c in st.STATE_SCHEMA.split(", ")}
    done = base.where("id = 'a'").withColumn("source_hash", F.lit("new"))
    after = {r.session: (r.state, r.source_hash, r.error) for r in st.record_uploaded(state, done, "me").collect()}
    assert after == {"a": ("current", "new", None), "b": ("changed", "h", "old")}
    other = {r.state for r in st.record_uploaded(state, done, "you").collect()}
    assert other == {"changed"}
    replaced = st.merge_state(state, state.where("session = 'b'").withColumn("state", F.lit("error")))
    assert {r.session: r.state for r in replaced.collect()} == {"a": "changed", "b": "error"}


def test_manifest_and_metadata(spark):
    sessions = spark.createDataFrame(
        [("pi", "p", "par", "x", "/x.jsonl", "k/x", "h", "f", None, "nick's repo", "human"), ("codex", "p", None, "y", "/y.txt", "k/y", "g", "f", None, "", None)],
        "source string, project_id string, parent string, id string, path string, key string, source_hash string, file_snapshot string, children_digest string, project_label string, launch_kind string",
    )
    counts = spark.createDataFrame([("/x.jsonl", 3)], "session string, member_redactions bigint")
    totals = spark.createDataFrame([("/x.jsonl", 2)], "session string, files bigint")
    made = {r.id: r for r in package.artifacts(sessions, counts, totals, "me", ["nick"]).collect()}
    assert json.loads(made["x"].manifest) == {
        "manifest_version": 7, "id": "pi--x", "format": "pi-session-jsonl-v3", "source": {"type": "pi", "id": "x"},
        "collection": {"type": "project", "contributor": "me", "name": "[USER]'s repo"},
        "redaction": {"policy": "sessionloom/1", "count": 4}, "launch_kind": "human", "parent_id": "pi--par",
    }
    assert "parent_id" not in json.loads(made["y"].manifest) and made["y"].launch_kind == "unknown"
    assert made["x"].metadata == {
        "mts-manifest-version": "7", "mts-transcript-id": "pi--x", "mts-source": "pi", "source-hash": "h", "source-hash-version": "5",
        "redaction-version": "1", "launch-kind": "human", "mts-parent-id": "pi--par",
    }
    assert "mts-parent-id" not in made["y"].metadata and made["x"].attachment_count == 2


def test_lost_candidates(spark):
    state = spark.createDataFrame([("codex", "p", None, "a", "changed", "h", "s"), ("codex", "p", None, "z", "changed", "h", "s")],
                                  "source string, project string, parent string, session string, state string, source_hash string, file_snapshot string")
    work, errors = package.split_candidates(state, refs(spark, "a", "b"))
    assert [r.id for r in work.collect()] == ["a"]
    assert [(r.session, r.error) for r in errors.collect()] == [("z", package.UNAVAILABLE)]


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "a int, b string")
    assert table.read().count() == 0
    table.write(spark.createDataFrame([(1, "x")], "a int, b string"), 3)
    table.write(spark.createDataFrame([(2, "y")], "a int, b string"), 10)
    (tmp_path / "t/version=11").mkdir()
    assert [r.a for r in table.read().collect()] == [2] and [r.a for r in table.read(before=10).collect()] == [1]
    assert table.read(before=3).count() == 0
    other = VersionedTable(spark, str(tmp_path / "t"), "a int, c string")
    assert other.read().count() == 0 and other.read().columns == ["a", "c"]


def test_bundles_of_the_newest_batch(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "b"), "key string, member_name string, content string")
    assert table.read().count() == 0
    row = lambda *r: spark.createDataFrame([r], "key string, member_name string, content string")
    table.write(row("k", "m", "one").unionByName(row("k", "gone", "x")), 0)
    table.write(row("k", "m", "two"), 1)
    table.write(row("k", "m", "two again"), 1)
    assert [(r.member_name, r.content) for r in current_bundles(table.read()).collect()] == [("m", "two again")]


def test_child_identifiers(spark):
    contents = {
        "deep": '{"a":{"b":[{"Agent-ID":"c1"}]}}', "list": '[{"session_ids":["c1",["c2"]]}]', "string": '{"t":"{\\"threadId\\": \\"c1\\"}"}',
        "mention": "see c1, not c2x", "odd": "odd/id. here, \u00e9!", "none": '{"agentId": 5}', "broken": '{"agentId":"c9"',
    }
    results = spark.createDataFrame([("s", i, "c", v, None) for i, v in enumerate(contents.values())], "session string, step int, call_id string, content string, extra string")
    calls = spark.createDataFrame([("s", i, "c", "codex", "multi.Spawn-Agent") for i in range(len(contents))], "session string, step int, call_id string, source string, function_name string")
    children = spark.createDataFrame([("s", "codex", c) for c in ("c1", "c2", "odd/id", "c9", "here/id", "\u00e9!")], "session string, source string, child_id string")
    got = {}
    for r in T.child_references(calls, results, children).collect():
        got.setdefault(list(contents)[r.step], set()).add(r.session_id)
    assert got == {"deep": {"c1"}, "list": {"c1", "c2"}, "string": {"c1"}, "mention": {"c1"}, "odd": {"odd/id", "\u00e9!"}, "broken": {"c9"}}
    some = T.child_references(calls, results, children).where("step = 0").select("session", "step", "call_id", "trajectory_id")
    assert T.child_references(calls, results, children, some).where("step = 0").count() == 0


def test_aliases_and_spawn_tools(spark):
    rows = [("s", "claude_code", "agent-1"), ("s", "claude_code", "agent_1"), ("s", "claude_code", "x"), ("s", "codex", "agent-9")]
    got = {(r.alias, r.child_id) for r in T.child_aliases(spark.createDataFrame(rows, "session string, source string, child_id string")).collect()}
    assert got == {("agent-1", "agent-1"), ("agent_1", "agent_1"), ("x", "x"), ("agent-9", "agent-9")}
    tools = [("claude_code", "Task", True), ("claude_code", "-AGENT-", True), ("claude_code", "spawn_agent", False), ("codex", "x.spawn agent", True), ("pi", "task", False)]
    frame = spark.createDataFrame(tools, "s string, f string, e boolean")
    assert frame.where(T.is_spawn_tool(F.col("s"), F.col("f")) != F.col("e")).count() == 0
    reports = spark.createDataFrame([("a", "pi", None), ("b", "codex", "boom"), ("c", "codex", None)], "session string, source string, error string")
    assert [tuple(r) for r in T.conversion_report(reports).orderBy("session").collect()] == [("a", "unsupported", None), ("b", "failed", "boom"), ("c", "complete", None)]


def test_preview_bounds(spark):
    rows = [("s", i, "user", f"m{i} jo@host.org") for i in range(250)]
    frame = spark.createDataFrame(rows, "session string, seq int, role string, text string")
    first = preview.page(frame, ["session"], b"0" * 16, offset=-5, limit=500)
    assert first.count() == 100 and first.agg(F.max("position")).first()[0] == 99
    row = preview.page(frame, ["session"], b"0" * 16, offset=249, limit=0).first()
    assert (row.position, row.text, row.redaction_count, row.next_offset, row.has_more, row.total_messages) == (249, "m249 [EMAIL]", 1, 250, False, 250)
    long = frame.where("seq = 0").withColumn("text", F.repeat(F.lit("x"), F.lit(2001)))
    assert preview.page(long, ["session"], b"0" * 16).first().text == "x" * 2000 + "..."


def test_selection_ignores_unknown_and_repeated(spark):
    picked = spark.createDataFrame([("codex", "p", "", "a"), ("codex", "p", None, "a"), ("codex", "p", "q", "b"), ("codex", "x", None, "b")], "source string, project string, parent string, session string")
    assert [r.id for r in st.resolve_selection(picked, refs(spark, "a", "b")).collect()] == ["a"]


def test_mentions_come_from_string_values(spark):
    deep = '{"x":[' * 9 + '{"agentId":[[["c1"]]]}' + "]}" * 9
    rows = [(deep, None), ("-", '{"t":"line\\nc1 done"}'), ("-", '{"c1":true}'), ('["see c1"]', None), ('[{"c1":"x"}]', None), ('{"c1":true}', None)]
    results = spark.createDataFrame([("s", i, "c", a, b) for i, (a, b) in enumerate(rows)], "session string, step int, call_id string, content string, extra string")
    calls = spark.createDataFrame([("s", i, "c", "claude_code", "Task") for i in range(len(rows))], "session string, step int, call_id string, source string, function_name string")
    children = spark.createDataFrame([("s", "claude_code", "c1")], "session string, source string, child_id string")
    assert {r.step for r in T.child_references(calls, results, children).collect()} == {0, 1, 3, 5}
