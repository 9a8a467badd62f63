"""Attachment pointers, budget, names and content hashes against plain Python."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import attachments as A
from sessionloom.operators import budget, snapshot
from sessionloom.operators.budget import _walk, within_budget

FILES = "session string, kind string, path string, size bigint"


def greedy(rows, budget):
    kept, spent = {}, {}
    for session, kind, path, size in sorted(rows):
        fits = spent.get(session, 0) + size <= budget
        kept[session, path] = fits
        spent[session] = spent.get(session, 0) + size * fits
    return kept


def chosen(frame):
    return {(r.session, r.path): r.kept for r in frame.collect()}


def test_budget_example(spark):
    rows = [("s", "k", "a", 60), ("s", "k", "b", 50), ("s", "k", "c", 30)]
    assert chosen(within_budget(spark.createDataFrame(rows, FILES), 100)) == {("s", "a"): True, ("s", "b"): False, ("s", "c"): True}


@pytest.mark.parametrize("budget", [0, 64, 700])
def test_large_sessions_are_chosen_like_small_ones(spark, budget):
    rng = random.Random(budget)
    rows = [("hot", rng.choice("ab"), f"p{i:05d}", rng.choice([0, 0, 1, 2, 3, 40, 64, 65, 900])) for i in range(400)]
    rows += [("cold", "a", f"q{i}", rng.randint(0, 60)) for i in range(9)]
    rows += [("warm", "a", f"w{i:03d}", 100 - i) for i in range(60)]
    frame = spark.createDataFrame(rows, FILES)
    expected = greedy(rows, budget)
    assert chosen(within_budget(frame, budget)) == expected
    assert chosen(within_budget(frame, budget, fold_limit=20)) == expected


def test_only_sessions_that_a_range_boundary_cuts_are_chosen_in_phases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(budget, "checkpoint_folder", lambda *_: str(tmp_path))
    rows = [(f"s{i:03d}", "a", f"p{j:02d}", (i * j) % 41) for i in range(300) for j in range(30)]
    found = chosen(within_budget(spark.createDataFrame(rows, FILES), 150, fold_limit=2))
    assert found == greedy(rows, 150)
    (work,) = tmp_path.glob("budget-*")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < spark.read.parquet(f"{work}/phase-0").count() <= 30 * (slices - 1)


def test_walk_keeps_what_was_spent_over_batches_and_files_without_a_size(spark):
    batches = [pa.record_batch({"session": [None, None, "a"], "size": [5, 6, 6]}), pa.record_batch({"session": ["a", "a", "b"], "size": [None, 4, 9]})]
    assert [b.column("kept").to_pylist() for b in _walk(10)(iter(batches))] == [[True, False, True], [None, True, True]]


DELIMITERS = " \t\r\n\"'\\<>,)]"


def scan_pointers(text, marker, suffix=""):
    """From the last delimiter before each marker to the next delimiter or slash behind it."""
    name = re.compile("[^" + re.escape(DELIMITERS) + "/]*")
    openings = [0] + [i + 1 for i, c in enumerate(text) if c in DELIMITERS]
    tokens = [
        text[max(o for o in openings if o <= hit.start()) : name.match(text, hit.end()).end()]
        for hit in re.finditer(re.escape(marker), text)
    ]
    return [t for t in tokens if t[0] == "/" and t.endswith(suffix)]


def test_pointers_equal_a_character_scan(spark):
    rng = random.Random(5)
    parts = ["/a", "/tool-results/", "/tasks/", "x", ".output", " ", '"', "(", ")", "\\", "/", "\t", "é", "tool-results", ",", "]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.orderBy("i").select(
        A.marker_pointers(F.col("t"), A.TOOL_RESULTS).alias("r"), A.marker_pointers(F.col("t"), A.TASKS, A.TASK_SUFFIX).alias("o")
    ).collect()
    for text, row in zip(texts, rows):
        assert row.r == scan_pointers(text, "/tool-results/"), text
        assert row.o == scan_pointers(text, "/tasks/", ".output"), text


def test_attach_outcomes(spark):
    place = "struct<phase:int,seq:int,at:int>"
    pointers = spark.createDataFrame(
        [
            ("s1", "/p/tool-results/x.txt", "tool-results", (0, 1, 0)), ("s1", "/p//tool-results/./x.txt", "tool-results", (0, 0, 0)),
            ("s1", "/p/s2/tool-results/x.txt", "tool-results", (0, 2, 0)), ("s1", "/p/gone", "tool-results", (0, 3, 0)),
            ("s1", "/p/link", "tool-results", (0, 4, 0)), ("s1", "/p2/other", "tool-results", (0, 5, 0)), ("s1", "rel", "tool-results", (0, 6, 0)),
            ("s1", "/p/dir", "tool-results", (0, 7, 0)), ("s1", "/p/dir/../big", "tool-results", (0, 8, 0)), ("s1", "/tmp/t/a.output", "task-outputs", (1, 0, 0)),
            ("s2", "/p/gone", "tool-results", (0, 0, 0)),
        ],
        f"session string, pointer string, kind string, place {place}",
    )
    files = spark.createDataFrame(
        [
            ("/p/tool-results/x.txt", "/roots/p/tool-results/x.txt", True, 10), ("/p/s2/tool-results/x.txt", "/roots/p/s2/tool-results/x.txt", True, 20),
            ("/p/link", "/elsewhere/file", True, 1), ("/p/dir", "/roots/p/dir", False, 0), ("/p/big", "/roots/p/big", True, 1000),
            ("/tmp/t/a.output", "/tmp/t/a.output", True, 5),
        ],
        "path string, real_path string, is_file boolean, size bigint",
    )
    roots = A.fixed_roots([("/p", "/roots/p"), ("/tmp/t", "/tmp/t")])
    done = A.attach(pointers, files, roots, budget=100)
    got = {(r.session, r.outcome, r.reference): (r.arcname, r.size) for r in done.collect()}
    digest = hashlib.sha256(b"/roots/p/tool-results/x.txt").hexdigest()[:8]
    assert digest != "cdc6a821" and hashlib.sha256(b"/roots/p/s2/tool-results/x.txt").hexdigest()[:8] == "cdc6a821"
    # In path order /roots/p/s2/… comes first and keeps the plain name.
    assert got == {
        ("s1", "file", "/p//tool-results/./x.txt"): (f"tool-results/x-{digest}.txt", 10),
        ("s1", "file", "/p/s2/tool-results/x.txt"): ("tool-results/x.txt", 20),
        ("s1", "file", "/tmp/t/a.output"): ("task-outputs/a.output", 5),
        ("s1", "skipped", "/p/dir/../big"): (None, 1000),
        ("s1", "missing", "/p/gone"): (None, None), ("s2", "missing", "/p/gone"): (None, None),
    }
    totals = {r.session: (r.total_bytes, r.files, r.missing, r.skipped) for r in A.totals(done).collect()}
    assert totals == {"s1": (35, 3, 1, 1), "s2": (0, 0, 1, 0)}


def test_outcomes_are_read_from_what_the_pointers_lead_to_once(spark):
    place = "struct<phase:int,seq:int,at:int>"
    pointers = spark.createDataFrame(
        [("s", "/r/a", "k", (0, 0, 0)), ("s", "/r/./a", "k", (0, 1, 0)), ("s", "/r/b", "k", (0, 2, 0)), ("s", "/r/gone", "k", (0, 3, 0)), ("s", "/r/away", "k", (0, 4, 0)),
         ("t", "/r/gone", "k", (0, 0, 0)), ("t", "/r//gone", "k", (0, 1, 0))],
        f"session string, pointer string, kind string, place {place}",
    )
    files = spark.createDataFrame(
        [("/r/a", "/r/a", True, 60), ("/r/b", "/r/b", True, 50), ("/r/away", "/else", True, 1)],
        "path string, real_path string, is_file boolean, size bigint",
    )
    done = A.attach(pointers, files, A.fixed_roots([("/r", "/r")]), budget=100)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    found = {(r.session, r.reference, r.path, r.outcome) for r in done.collect()}
    assert found == {
        ("s", "/r/a", "/r/a", "file"), ("s", "/r/b", "/r/b", "skipped"), ("s", "/r/gone", None, "missing"),
        ("t", "/r/gone", None, "missing"), ("t", "/r//gone", None, "missing"),
    }


def test_plain_name_equal_to_a_digest_name(spark):
    first, second = "/a/x.txt", "/b/x.txt"
    digest = hashlib.sha256(second.encode()).hexdigest()[:8]
    third = f"/c/x-{digest}.txt"
    rows = [("s", "k", p, 1) for p in (first, second, third)]
    got = {r.path: r.arcname for r in A.archive_names(spark.createDataFrame(rows, FILES)).collect()}
    own = hashlib.sha256(third.encode()).hexdigest()[:8]
    assert got == {first: "k/x.txt", second: f"k/x-{digest}.txt", third: f"k/x-{digest}-{own}.txt"}


def test_owned_folder_and_editor_root(spark):
    sessions = spark.createDataFrame([("/c/p/s.jsonl", False), ("/c/p/s/subagents/k.jsonl", True)], "path string, is_subagent boolean")
    folders = A.owned_folders(sessions)
    assert [tuple(r) for r in folders.collect()] == [("/c/p/s.jsonl", "/c/p/s/tool-results")]
    lines = spark.createDataFrame([("/c/p/s.jsonl", 0, "see /c/p/s/tool-results/a.txt")], "path string, seq int, raw string")
    pointers = A.claude_pointers(lines)
    files = spark.createDataFrame([("/c/p/s/tool-results/a.txt",), ("/c/p/s/tool-results/b.txt",), ("/c/p/s/tool-results/d/e",)], "path string")
    more = A.folder_pointers(folders, files, "tool-results", pointers)
    assert sorted(r.pointer for r in pointers.unionByName(more).collect()) == ["/c/p/s/tool-results/a.txt", "/c/p/s/tool-results/a.txt", "/c/p/s/tool-results/b.txt"]
    row = spark.createDataFrame([("/u/app/agent-transcripts/x/x.jsonl",)], "session string").select(A.editor_root().alias("r")).first()
    assert row.r[0].root == "/u/app"


@pytest.mark.parametrize("limit", [10_000, 1])
def test_content_hash_vectors(spark, limit):
    body = b'{"type":"user"}\n'
    transcripts = spark.createDataFrame([("t", body), ("a", body), ("c", body)], "session string, content binary")
    digest = hashlib.sha256(b"out").hexdigest()
    files = spark.createDataFrame([(s, "tool-results", "/x.txt", "tool-results/x.txt", digest) for s in "ac"], "session string, kind string, path string, arcname string, content_digest string")
    children = spark.createDataFrame([("c", k) for k in ("k2", "k1", "k2")], "session string, child_id string")
    got = {r.session: r.source_hash for r in snapshot.source_hashes(transcripts, files, children, limit).collect()}
    assert got == {
        "t": "288691f12ddfdfd02604d02cc3eea3e1f155a94fafafd8e9181f81678c993e9c",
        "a": "27b4b2291c7d44d119285454a79f7a9c5cc4942e212fb552ae5fbb7df0edf1fd",
        "c": "a3c056ea51217e21f16cd5090dcb626a59f8bb1cbe95e95cf2d37b7ff0606d7f",
    }


def test_streamed_hash_equals_the_folded_one(spark):
    digests = spark.createDataFrame([("hot", "00"), ("cold", "11"), ("none", "22")], "session string, digest string")
    entries = spark.createDataFrame([("hot", f"k{i:05d}") for i in range(3000)] + [("cold", "x")], "session string, child_id string")
    entries = entries.withColumn("payload", snapshot.child_payload(F.col("child_id")))
    run = lambda n: {tuple(r) for r in snapshot.chain(digests, entries, ["session"], ["child_id"], "l", n).collect()}
    streamed, folded = run(100), run(10_000)
    assert streamed == folded and ("none", "22") in folded
    expected = hashlib.sha256(b"l\x0000" + b"".join(f"k{i:05d}".encode() + b"\0" for i in range(3000))).hexdigest()
    assert ("hot", expected) in streamed


def test_signatures(spark):
    files = spark.createDataFrame([("/a", 1), ("/b", 2)], "path string, size bigint").withColumn("modified", F.timestamp_seconds(F.lit(5)))
    watched = spark.createDataFrame([("s", "/a"), ("s", "/a"), ("s", "/gone"), ("t", "/b")], "session string, path string")
    signatures = snapshot.path_signatures(watched, files)
    assert {(r.session, r.path, r.exists) for r in signatures.collect()} == {("s", "/a", True), ("s", "/gone", False), ("t", "/b", True)}
    first = dict(map(tuple, snapshot.snapshot_digest(signatures).collect()))
    grown = snapshot.path_signatures(watched, files.withColumn("size", F.col("size") + (F.col("path") == "/b").cast("int")))
    second = dict(map(tuple, snapshot.snapshot_digest(grown).collect()))
    assert first["s"] == second["s"] and first["t"] != second["t"]
