"""Session files on disk, read back in all dialects."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import launch
from sessionloom.plans import scanning
from sessionloom.sources import codex, cursor
from sessionloom.sources.dialect import messages, read_events
from sessionloom.sources.files import decode_lines, quarantine, read_lines
from sessionloom.sources.registry import DIALECTS, register
from sessionloom.sources.scan import CorpusScan, scan_messages, scan_sessions

UUID = "0199aaaa-0000-4000-8000-00000000000a"


def write(path, *lines, end="\n", raw=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = raw if raw is not None else end.join(x if isinstance(x, str) else json.dumps(x) for x in lines).encode()
    path.write_bytes(data)


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, **more}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    home = tmp_path_factory.mktemp("home with space")
    claude, cdx, cur, pi = home / "claude/projects", home / "codex/sessions", home / "cursor/projects", home / "pi/agent/sessions"
    write(
        claude / "-srv-u1-repo/s1.jsonl", "", "   ", "not json", "[1,2]", '"text"', '{"a":1,"a":2}', '{"a":NaN}',
        {"type": "summary", "cwd": 5},
        user([{"type": "tool_result"}], cwd="/srv/u1/repo", promptSource="typed"),
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use"}, {"type": "tool_use", "name": None}, "bare", {"type": "x"}]}},
        {"type": "user"}, {"type": "assistant", "message": {"content": None}}, '{"type":"system","type":"user","message":{"content":7}}',
    )
    write(claude / "-srv-u1-repo/s1/subagents/agent-c1.jsonl", user("  " + "é" * 250 + "\t"), {"type": "user", "message": {"content": True}}, end="\r\n")
    write(claude / "-srv-u1-repo/empty.jsonl", raw=b"")
    write(claude / "-srv-u1-repo/blank.jsonl", raw=b"\n")
    write(claude / "-srv-u1-repo/bad.jsonl", raw=b'{"type":"user","message":{"content":"a\xffb"}}\r{"type":"user","message":{"content":"second"}}')
    meta = {"type": "session_meta", "payload": {"meta": {"cwd": "/srv/u2"}, "source": "cli", "originator": "codex-tui"}}
    write(
        cdx / f"2026/01/02/rollout-2026-{UUID}.jsonl", meta,
        {"type": "response_item", "payload": {"role": "user", "content": [{"type": "input_text", "text": "q"}, "bare", {"type": "refusal", "text": "no"}]}},
        {"role": "assistant", "content": "a"}, {"role": "system", "content": "s"}, {"role": "tool", "content": "t"},
    )
    spawn = {"subagent": {"thread_spawn": {"parent_thread_id": UUID}}}
    write(cdx / "rollout-child.jsonl", {"type": "session_meta", "payload": {"source": spawn, "cwd": "", "session": {"working_directory": "/w"}}})
    write(cdx / "rollout-review.jsonl", {"type": "session_meta", "payload": {"source": {"subagent": "review"}}})
    write(cdx / "rollout-none.jsonl", "garbage")
    write(cdx / "other.jsonl", meta)
    base = cur / "srv-u3-app/agent-transcripts"
    write(base / "c1/c1.jsonl", {"role": "user", "message": {"content": [{"type": "text", "text": ""}, "x", {"type": "tool_use", "toolName": "edit"}]}}, {"role": "assistant", "content": "y"})
    write(base / "c1/subagents/k1.jsonl", {"role": "user", "content": "child"})
    write(base / "old.TXT", raw="noise\nUser: hello  \n\nmore \n ASSISTANT: :\nCursor: done\nhuman\n\nassistant:\n  tail end\n".encode())
    write(base / "plain.txt", raw=b"  just text \n")
    write(base / "jsoninside.txt", {"role": "user", "content": "json in txt"})
    write(base / ".hidden.txt", raw=b"User: no")
    write(cur / "srv-u3-app/other/x.txt", raw=b"User: no")
    header = {"type": "session", "version": 3, "id": "p1", "cwd": "/srv/u4"}
    message = {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "t"}, {"type": "thinking"}, {"type": "toolCall", "name": "x"}, {"type": "image"}, "s"]}}
    write(pi / "--srv-u4--/2026_p1.jsonl", header, message, {"type": "message", "message": {"content": "no role"}}, {"type": "other"})
    write(pi / "--srv-u4--/2026_fork.jsonl", {"type": "session", "parentSession": "/x/2026_p1.jsonl"}, message)
    write(pi / "2026_p1/r7/run-1/session.jsonl", {"type": "session", "cwd": "/srv/u4"}, message)
    write(pi / "2026_p1/r7/run-1/events.jsonl", header)
    write(pi / "--srv-u4--/nohead.jsonl", message)
    write(home / "pi/agent/2025_flat.jsonl", {"type": "session"})
    return {"claude_code": str(claude), "codex": str(cdx), "cursor": str(cur), "pi": str(pi)}


@pytest.fixture(scope="module")
def rows(spark, corpus):
    found = scan_sessions(spark, {s: r for s, r in corpus.items() if s != "claude_code"}).collect()
    # An inventory of the caller's own also lists files without a byte.
    listed = [(os.path.join(d, f), os.path.getsize(os.path.join(d, f))) for d, _, names in os.walk(corpus["claude_code"]) for f in names]
    inventory = spark.createDataFrame(listed, "path string, size bigint").withColumn("modified", F.timestamp_seconds(F.lit(1)))
    found += CorpusScan(spark, "claude_code", corpus["claude_code"], inventory=inventory).sessions().collect()
    return {(r.source, r.path.split("/")[-1] if r.source != "pi" or "run-1" not in r.path else "run"): r for r in found}


def test_which_files_are_transcripts(rows):
    assert set(rows) == {
        ("claude_code", "s1.jsonl"), ("claude_code", "agent-c1.jsonl"), ("claude_code", "empty.jsonl"), ("claude_code", "blank.jsonl"), ("claude_code", "bad.jsonl"),
        ("codex", f"rollout-2026-{UUID}.jsonl"), ("codex", "rollout-child.jsonl"), ("codex", "rollout-none.jsonl"),
        ("cursor", "c1.jsonl"), ("cursor", "k1.jsonl"), ("cursor", "old.TXT"), ("cursor", "plain.txt"), ("cursor", "jsoninside.txt"),
        ("pi", "2026_p1.jsonl"), ("pi", "2026_fork.jsonl"), ("pi", "run"), ("pi", "2025_flat.jsonl"),
    }


def test_claude_sessions(rows):
    top = rows["claude_code", "s1.jsonl"]
    assert (top.id, top.parent, top.is_subagent, top.cwd) == ("s1", None, False, "/srv/u1/repo")
    assert (top.message_count, top.first_message, top.own_kind) == (5, "[Tool Result]", "human")
    child = rows["claude_code", "agent-c1.jsonl"]
    assert (child.id, child.parent, child.is_subagent, child.message_count) == ("agent-c1", "s1", True, 2)
    assert child.first_message == "é" * 200 + "..."
    empty = rows["claude_code", "empty.jsonl"]
    assert (empty.message_count, empty.first_message, empty.size_bytes) == (0, "(empty session)", 0)
    assert rows["claude_code", "blank.jsonl"].first_message == "(empty session)"
    assert rows["claude_code", "bad.jsonl"].first_message == "a�b" and rows["claude_code", "bad.jsonl"].message_count == 2
    assert "home with space" in top.path


def test_codex_sessions(rows):
    top = rows["codex", f"rollout-2026-{UUID}.jsonl"]
    assert (top.id, top.cwd, top.message_count, top.first_message) == (UUID, "/srv/u2", 2, "q\nbare")
    assert top.own_kind == "human"
    child = rows["codex", "rollout-child.jsonl"]
    assert (child.id, child.parent, child.is_subagent, child.cwd) == ("rollout-child", UUID, True, "/w")


def test_cursor_sessions(rows):
    assert rows["cursor", "c1.jsonl"].id == "c1" and rows["cursor", "c1.jsonl"].first_message == "x\n[Tool: edit]"
    child = rows["cursor", "k1.jsonl"]
    assert (child.id, child.parent, child.is_subagent) == ("k1", "c1", True)
    text = rows["cursor", "old.TXT"]
    assert (text.id, text.first_message, text.message_count) == ("old", "hello\n\nmore \n ASSISTANT: :", 3)
    assert rows["cursor", "plain.txt"].message_count == 1


def test_pi_sessions(rows):
    top = rows["pi", "2026_p1.jsonl"]
    assert (top.id, top.parent, top.cwd, top.message_count) == ("p1", None, "/srv/u4", 1)
    assert top.first_message == "t\n[thinking]\n[Tool: x]\n[image]\ns"
    fork = rows["pi", "2026_fork.jsonl"]
    assert (fork.id, fork.parent, fork.is_subagent) == ("fork", "p1", True)
    run = rows["pi", "run"]
    assert (run.id, run.parent, run.is_subagent) == ("r7-run-1", "p1", True)
    assert rows["pi", "2025_flat.jsonl"].id == "flat"


def test_messages(spark, corpus):
    got = {}
    for r in scan_messages(spark, corpus).orderBy("path", "seq").collect():
        got.setdefault(r.path.split("/")[-1], []).append((r.role, r.text))
    assert got["s1.jsonl"] == [
        ("user", "[Tool Result]"), ("assistant", "hi\n[Tool: ?]\n[Tool: None]"), ("user", ""), ("assistant", "None"), ("user", "7"),
    ]
    assert got["agent-c1.jsonl"][1] == ("user", "True")
    assert got[f"rollout-2026-{UUID}.jsonl"] == [("user", "q\nbare"), ("assistant", "a"), ("system", "s")]
    assert got["c1.jsonl"] == [("user", "x\n[Tool: edit]"), ("assistant", "y")]
    assert got["old.TXT"] == [("user", "hello\n\nmore \n ASSISTANT: :"), ("assistant", "done"), ("assistant", "tail\nend")]
    assert got["plain.txt"] == [("assistant", "just text")]
    assert got["jsoninside.txt"] == [("user", "json in txt")]
    assert got["2026_p1.jsonl"][1] == ("user", "no role")


def test_quarantine_keeps_rejected_lines(spark, corpus):
    lines = CorpusScan(spark, "claude_code", corpus["claude_code"]).lines()
    rejected = {(r.raw, r.reason) for r in quarantine(lines).collect()}
    assert {("not json", "not an object"), ("[1,2]", "not an object"), ('"text"', "not an object")} == rejected  # NaN is read
    kept = decode_lines(lines).count() + len(rejected)
    assert kept == lines.where(F.trim("raw") != "").count()


def test_line_order_survives_many_blocks(spark, tmp_path):
    n = 4000
    write(tmp_path / "p/a.jsonl", *[{"type": "user", "message": {"content": f"m{i}"}} for i in range(n)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = read_lines(spark, str(tmp_path / "p"))
        assert lines.rdd.getNumPartitions() > 3
        got = [r.text for r in messages(read_events(decode_lines(lines), DIALECTS["claude_code"])).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"m{i}" for i in range(n)]


def test_only_changed_files_are_read(spark, tmp_path):
    import datetime as dt

    for name, age in (("old", 1_000_000_000), ("new", 1_700_000_000)):
        write(tmp_path / f"root/-p/{name}.jsonl", user(name))
        os.utime(tmp_path / f"root/-p/{name}.jsonl", (age, age))
    since = dt.datetime.fromtimestamp(1_600_000_000)
    scan = CorpusScan(spark, "claude_code", str(tmp_path / "root"), modified_since=since)
    assert [r.id for r in scan.sessions().collect()] == ["new"]
    assert scan.lines().count() == 1


@pytest.mark.parametrize(
    "tag, expected",
    [('"cli"', "top"), ("null", "top"), ('{"custom":"x"}', "top"), ('{"internal":1}', "drop"), ('{"subagent":"compact"}', "drop"),
     ('{"subagent":{"other":"x"}}', "task"), ('{"else":1}', "top"), ("[1]", "top")],
)
def test_session_class(spark, tag, expected):
    frame = spark.createDataFrame([(tag,)], "t string").select(codex.session_class(F.try_parse_json("t")))
    assert frame.first()[0] == expected


@pytest.mark.parametrize(
    "event, expected",
    [
        ({"promptSource": "typed"}, "human"), ({"promptSource": "queued"}, "human"), ({"promptSource": "sdk"}, "programmatic"),
        ({"promptSource": "system"}, None), ({"entrypoint": "sdk-ts", "origin": {"kind": "human"}}, "programmatic"),
        ({"origin": {"kind": "human"}}, "human"), ({"origin": "human"}, None), ({"entrypoint": "cli"}, None),
        ({"type": "session_meta", "payload": {"source": "exec"}}, "programmatic"),
        ({"type": "session_meta", "payload": {"source": "CLI", "originator": "my-sdk-host"}}, "programmatic"),
        ({"type": "session_meta", "payload": {"source": "vscode", "originator": "new"}}, "human"),
        ({"type": "session_meta", "payload": {"source": {"x": "exec"}, "originator": "Codex-TUI"}}, "human"),
        ({"type": "session_meta", "payload": {}, "promptSource": "typed"}, "human"),
        ({"type": "session_meta", "payload": "x"}, None),
    ],
)
def test_event_verdict(spark, event, expected):
    frame = spark.createDataFrame([(json.dumps(event),)], "t string").select(launch.event_verdict(F.try_parse_json("t")))
    assert frame.first()[0] == expected


def test_children_inherit_from_direct_parents_only(spark):
    rows = [("s", "root", None, "human"), ("s", "mid", "root", "unknown"), ("s", "leaf", "mid", "unknown"), ("s", "own", "root", "programmatic"), ("s", "lost", "gone", "unknown")]
    frame = spark.createDataFrame(rows, "source string, id string, parent string, own_kind string")
    got = {r.id: r.launch_kind for r in launch.inherit_launch_kind(frame).collect()}
    assert got == {"root": "human", "mid": "human", "leaf": "unknown", "own": "programmatic", "lost": "unknown"}


def test_turns_of_odd_texts(spark):
    texts = ["", "  \n", "User:\nAssistant:", "USER::\nx", "user \r\nx\ry", "Users: a", "User:a\nUser: b", "Human: \t q \n r"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[tuple(x) for x in r.turns] for r in frame.orderBy("i").select(cursor.text_turns(F.col("t")).alias("turns")).collect()]
    assert got == [
        [], [], [("assistant", "User:\nAssistant:")], [("user", "x")], [("user", "x\ny")], [("assistant", "Users: a")],
        [("user", "a"), ("user", "b")], [("user", "q\n r")],
    ]


def test_lines_hold_one_value_of_any_length(spark):
    rows = ['{"a":1}', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1} x}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":', '{"a":"' + "x" * 21_000_000 + '"}', "{}", '{"a":1}]}', '{"a":1}],[{"b":1}']
    frame = spark.createDataFrame(list(enumerate(rows)), "n int, raw string")
    assert {r.n for r in decode_lines(frame).select("n").collect()} == {0, 4, 5, 7, 8}
    assert {r.n for r in quarantine(frame).collect()} == {1, 2, 3, 6, 9, 10}


@pytest.mark.parametrize("depth", [0, 2, 3, 4, 5, 40])
def test_working_directory_at_any_depth(spark, depth):
    line = '{"payload":' + '{"meta":' * depth + '{"cwd":"/deep"}' + "}" * depth + ',"session":{"cwd":"/later"}}'
    frame = spark.createDataFrame([(line,), ('{"a":1}',)], "raw string")
    assert [r[0] for r in decode_lines(frame).select(codex.find_cwd(F.col("v"), F.col("raw"))).collect()] == ["/deep", None]
    assert codex.walk_cwd(line) == "/deep"


def test_every_dialect_reads_its_lines_once_for_sessions(spark, corpus):
    for source, root in corpus.items():
        plan = CorpusScan(spark, source, root).sessions()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan text") == 1, source


def test_files_of_other_folders_are_not_opened(spark, tmp_path):
    write(tmp_path / "root/-p/a.jsonl", user("a"))
    write(tmp_path / "root/-p/deep/er/b.jsonl", user("b"))
    scan = CorpusScan(spark, "claude_code", str(tmp_path / "root"))
    assert [r.path.split("/")[-1] for r in scan.lines().collect()] == ["a.jsonl"]
    plan = scan.lines()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "file_path" in plan.split("DataFilters")[1].split("]")[0]


def test_names_with_a_percent_sign(spark, tmp_path):
    write(tmp_path / "root/-p/a%20b+c.jsonl", user("a"))
    scan = CorpusScan(spark, "claude_code", str(tmp_path / "root"))
    assert [(r.id, r.message_count) for r in scan.sessions().collect()] == [("a%20b+c", 1)]


def test_editor_lines_without_an_object_are_turns(spark, tmp_path):
    base = tmp_path / "root/p/agent-transcripts"
    write(base / "a.jsonl", "User: hi", "more", "", "Assistant:", "yes")
    write(base / "b.jsonl", "noise", {"role": "user", "content": "json"}, "User: no")
    write(base / "c.txt", {"role": "user", "content": "one"}, "noise", {"role": "assistant", "content": "two"}, end="\r\n")
    found = CorpusScan(spark, "cursor", str(tmp_path / "root")).messages().orderBy("path", "seq").collect()
    assert [(r.path[-7:-4] if r.path.endswith("txt") else r.path[-7], r.role, r.text) for r in found] == [
        ("a", "user", "hi\nmore"), ("a", "assistant", "yes"), ("b", "user", "json"), ("s/c", "user", "one"), ("s/c", "assistant", "two"),
    ]


def test_pointers_of_a_dialect(spark, tmp_path):
    write(tmp_path / "c/-p/a.jsonl", user("saved to /x/tool-results/1.txt"), user("and /y/tasks/2.output"))
    write(tmp_path / "e/p/agent-transcripts/a.jsonl", {"role": "user", "content": "/x/terminals/3.txt"})
    write(tmp_path / "e/p/agent-transcripts/b.txt", "User: see /x/agent-tools/4.txt")
    write(tmp_path / "pi/--p--/1_a.jsonl", {"type": "session"})
    roots = {"claude_code": "c", "cursor": "e", "pi": "pi"}
    found = {s: {(r.pointer, r.kind) for r in CorpusScan(spark, s, str(tmp_path / d)).pointers().collect()} for s, d in roots.items()}
    assert found["claude_code"] == {("/x/tool-results/1.txt", "tool-results"), ("/y/tasks/2.output", "task-outputs")}
    assert found["cursor"] == {("/x/terminals/3.txt", "terminals"), ("/x/agent-tools/4.txt", "agent-tools")}
    assert found["pi"] == set()


def test_a_registered_dialect_is_scanned(spark, tmp_path):
    write(tmp_path / "user_id=7/part-0.txt", {"actor": "click", "said": "see /srv/logs/1.txt", "from": "/w"}, "junk", {"actor": "error", "said": "x"})
    write(tmp_path / "elsewhere/part-0.txt", {"actor": "click"})
    register(scanning.ACTIVITY)
    (row,) = scan_sessions(spark, {"activity": str(tmp_path)}).collect()
    assert (row.source, row.id, row.cwd, row.message_count, row.first_message) == ("activity", "7", "/w", 1, "see /srv/logs/1.txt")
    assert [r.role for r in scan_messages(spark, {"activity": str(tmp_path)}).orderBy("seq").collect()] == ["click", "error"]
