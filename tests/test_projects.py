"""Project identity, merging, children and listing."""

import datetime as dt

from pyspark.sql import functions as F

from sessionloom.functions import naming
from sessionloom.functions.text import human_size, iso_utc, path_stem, path_suffix
from sessionloom.operators import consent, listing
from sessionloom.operators import projects as P

SESSION = "source string, id string, parent string, path string, cwd string, folder string, modified timestamp, n int"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def identify(spark, paths, roots=(), memory=()):
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    found = P.identify(
        frame,
        spark.createDataFrame(list(roots), "root string, main_root string"),
        spark.createDataFrame(list(memory), "worktree string, identity string, name string"),
    )
    return {r.path: r for r in found.collect()}


def test_project_keys(spark):
    got = identify(spark, ["/srv/u1/repo", "/srv/u1/.codex/worktrees/ab/gone", "/", "rel/x", "C:\\a\\b\\"])
    assert got["/srv/u1/repo"].project_key == "_project-repo-8213327634e0"
    assert got["/srv/u1/repo"].label == "repo" and got["/srv/u1/repo"].directory == "/srv/u1/repo"
    gone = got["/srv/u1/.codex/worktrees/ab/gone"]
    assert (gone.project_key, gone.directory, gone.label) == ("_project-gone-6278b5cb0cb9", None, "gone")
    assert got["/"].directory is None and got["/"].label == "_root"
    assert got["rel/x"].directory is None and got["rel/x"].identity == "stale:rel/x"
    assert got["C:\\a\\b\\"].label == "b"


def test_nearest_repository_and_worktrees(spark):
    roots = [("/r", "/r"), ("/r/in", "/main"), ("/", "/")]
    got = identify(spark, ["/r/in/x", "/r/y/z", "/r/x/.claude/worktrees/w/q", "/else", "/h/codex/worktrees/1/n/d"], roots[:2], [("/h/codex/worktrees/1/n", "/kept", "keep")])
    assert got["/r/in/x"].directory == "/main" and got["/r/y/z"].directory == "/r"
    assert got["/r/x/.claude/worktrees/w/q"].directory == "/r/x"
    assert got["/else"].directory == "/else"
    kept = got["/h/codex/worktrees/1/n/d"]
    assert (kept.directory, kept.identity, kept.label) == (None, "/kept", "keep")
    rooted = identify(spark, ["/else", "/h/codex/worktrees/1/n/d"], roots[2:])
    assert rooted["/else"].directory == "/"
    remembered = P.remember(spark.createDataFrame(list(rooted.values()))).collect()
    assert [(r.worktree, r.identity) for r in remembered] == [("/h/codex/worktrees/1/n", "/")]


def test_decoding_folders(spark):
    assert one(spark, P.decode_dashes, "-Users-alice-Git-foo") == "/Users/alice/Git/foo"
    assert one(spark, P.decode_editor_folder, "Users-alice-src") == "/Users/alice/src"
    assert one(spark, P.decode_editor_folder, "empty-window") == "empty-window"
    assert one(spark, P.decode_editor_folder, "1700000") == "1700000"
    assert one(spark, P.decode_editor_folder, "Users-a-.codex-worktrees-3f-my-repo") == "/Users/a/.codex/worktrees/3f/my-repo"
    assert one(spark, P.decode_editor_folder, "codex-worktrees-3f-repo") == "/.codex/worktrees/3f/repo"


def test_recover_prefers_long_components(spark):
    folders = spark.createDataFrame([("-srv-a-b-c",), ("srv-x",), ("none",)], "folder string")
    directories = spark.createDataFrame([("/srv/a/b/c",), ("/srv/a-b/c",), ("/srv/a/b-c",), ("/srv/x",), ("/srv/a--b/c",)], "path string")
    got = {r.folder: r.recovered for r in P.recover_folders(folders, directories).collect()}
    assert got == {"-srv-a-b-c": "/srv/a-b/c", "srv-x": "/srv/x"}


def test_path_dictionary(spark):
    value = '{"a":[{"fsPath":"/srv/x y"},{"path":"/srv/\\u0078"}],"path":"rel","b":{"path":"\\\\\\\\host\\\\p","n":{"fsPath":"/z-1"}}}'
    rows = [("glass.cloudAgentProjects.v1", '{"path":"/z/1"}'), ("glass.localAgentProjects.v1", value), ("other", '{"path":"/no"}'), ("glass.localAgentProjects.v1", "broken {")]
    got = {r.folder: r.path for r in P.path_dictionary(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert got == {"srv-x y": "/srv/x y", "srv-x": "/srv/x", "host-p": "\\\\host\\p", "z-1": "/z-1"}


def test_assign_merge_and_roll_up(spark):
    t = lambda n: dt.datetime(2026, 1, n, tzinfo=dt.timezone.utc)
    rows = [
        ("claude_code", "a", None, "/c/-srv-app/a.jsonl", None, "-srv-app", t(1), 1),
        ("claude_code", "b", None, "/c/-srv-app/b.jsonl", "/srv/app/sub", "-srv-app", t(2), 2),
        ("claude_code", "k", "b", "/c/-srv-app/b/subagents/k.jsonl", None, "-srv-app", t(3), 3),
        ("claude_code", "g", None, "/c/-gone-x/g.jsonl", None, "-gone-x", t(4), 4),
        ("codex", "c", None, "/x/c.jsonl", "/srv/app", None, t(5), 5),
        ("codex", "n", None, "/x/n.jsonl", None, None, t(6), 6),
        ("cursor", "e", None, "/u/app/agent-transcripts/e.jsonl", None, "app", t(7), 7),
    ]
    sessions = spark.createDataFrame(rows, SESSION).withColumn("ordinal", F.col("n"))
    placed = P.assign_projects(
        sessions,
        spark.createDataFrame([("/srv/app", "/srv/app")], "root string, main_root string"),
        spark.createDataFrame([("/none",)], "path string"),
        spark.createDataFrame([("zzz", "/zzz")], "folder string, path string"),
        spark.createDataFrame([], "worktree string, identity string, name string"),
    )
    merged = P.merge_projects(placed)
    got = {r.id: (r.project_label, r.project_directory, r.project_id) for r in merged.collect()}
    assert got["a"] == got["b"] == got["k"] == got["c"] == ("app", "/srv/app", "directory:/srv/app")
    assert got["g"] == ("x", None, "unresolved:x")
    assert got["n"] == ("(unknown project)", None, "unresolved:(unknown project)")
    # Its folder decodes to /app; the label has exactly one known directory.
    assert got["e"] == ("app", "/srv/app", "directory:/srv/app")
    found = P.projects(merged).collect()
    assert [p.label for p in found] == ["app", "(unknown project)", "x"] and found[0].session_count == 5
    rolled = [(r.source, r.session_count) for r in P.harness_rollup(merged).where("project_id = 'directory:/srv/app'").collect()]
    assert rolled == [("cursor", 1), ("codex", 1), ("claude_code", 3)]
    assert [(r.parent, r.child_id) for r in P.child_links(merged).collect()] == [("b", "k")]


def test_last_session_with_a_key_wins(spark):
    rows = [("s", "p", None, "x", "/1", 1), ("s", "p", "", "x", "/2", 2), ("s", "p", "q", "x", "/3", 3)]
    frame = spark.createDataFrame(rows, "source string, project_id string, parent string, id string, path string, n int").withColumn("ordinal", F.col("n"))
    assert sorted(r.path for r in P.current_sessions(frame).collect()) == ["/2", "/3"]


def test_storage_names(spark):
    for value, expected in (("Jane Doe", "Jane-Doe--01332c87"), ("a b/c", "a-b-c--539138d5"), ("", "unknown--e3b0c442"), ("ok.1", "ok.1"), (" ok ", "ok")):
        assert one(spark, naming.safe_segment, value) == expected
    assert one(spark, naming.project_segment, "a%b/c\\d") == "a%25b%2Fc%5Cd"
    assert one(spark, naming.project_segment, "") == "%00"
    assert one(spark, naming.contributor_name, " é ") == "-" and one(spark, naming.contributor_name, "\t") == "anonymous"
    assert one(spark, naming.native_member, "/a/b.JSONL") == "transcript.jsonl" and one(spark, naming.native_member, "/a/b") == "transcript.txt"


def test_small_expressions(spark):
    for path, stem, suffix in (("/a/b.tar.gz", "b.tar", ".gz"), ("/a/.rc", ".rc", ""), ("/a/b", "b", ""), ("/a/b.", "b.", "")):
        assert (one(spark, path_stem, path), one(spark, path_suffix, path)) == (stem, suffix)
    sizes = {0: "0.0 B", 1023: "1023.0 B", 1024: "1.0 KB", 1536: "1.5 KB", 1 << 20: "1.0 MB", 1 << 30: "1.0 GB", 1 << 40: "1.0 TB", 5 << 50: "5120.0 TB"}
    frame = spark.createDataFrame([(k,) for k in sizes], "n bigint").select("n", human_size(F.col("n")))
    assert dict(map(tuple, frame.collect())) == sizes
    assert spark.range(1).select(iso_utc(F.timestamp_seconds(F.lit(1_700_000_000)))).first()[0] == "2023-11-14 22:13:20 UTC"


def test_listing(spark):
    keys = [("p/b/x.zip", 1), ("p/A/y/z.zip", 2), ("p/one.zip", 3), ("p/two.zip", 9), ("p/no.txt", 4), ("p/", 5), ("p//q.zip", 6), ("q/r.zip", 7)]
    objects = spark.createDataFrame(keys, "key string, n int").select("key", F.timestamp_seconds("n").alias("last_modified"))
    got = [(r.name, r.key, r.is_folder) for r in listing.list_prefix(objects, "p/").collect()]
    assert got == [("A", "p/A/", True), ("b", "p/b/", True), ("two.zip", "p/two.zip", False), ("one.zip", "p/one.zip", False)]


def test_consent(spark):
    frame = lambda rows, names="identity string, label string": spark.createDataFrame(rows, names)
    found = frame([("a", "A"), ("b", "B")])
    saved = frame([("b", "old"), ("z", "Z"), ("y", "Y"), ("", "blank"), ("b", "old")])
    ids = lambda *names: frame([(n,) for n in names], "identity string")
    as_set = lambda f: {tuple(r) for r in f.collect()}
    assert as_set(consent.allowed_projects(found, saved)) == {("b",)}
    assert as_set(consent.allowed_projects(found, saved, True)) == {("a",), ("b",)}
    assert as_set(consent.invalid_requests(ids("a", "q", "y"), ids("y"), found)) == {("q",)}
    assert as_set(consent.update_consent(ids("a", ""), ids("y"), saved.where("identity <> ''"), found)) == {("a", "A"), ("z", "Z")}
    assert as_set(consent.update_consent(ids("a"), ids("b"), saved.where("identity <> ''"), found, True)) == {("z", "Z"), ("y", "Y")}
    assert as_set(consent.reported_consent(saved, found)) == {("b", "B"), ("z", "Z"), ("y", "Y")}
    assert [r.identity for r in consent.distinct_consent(saved).collect()] == ["b", "y", "z"]


def test_editor_state_is_walked_objects_first(spark):
    from sessionloom.operators.projects import APP_STATE_KEYS, path_dictionary, walk_paths

    value = '{"x":{"path":"/a-b"},"path":"/q","fsPath":"/a/b","l":[{"path":"C:"},{"path":"/z"}]}'
    assert walk_paths(value) == ["/a/b", "/q", "/a-b", "/z"]
    frame = spark.createDataFrame([(APP_STATE_KEYS[0], value), ("other", value), (APP_STATE_KEYS[0], "{"), (APP_STATE_KEYS[0], None)], "key string, value string")
    assert {(r.folder, r.path) for r in path_dictionary(frame).collect()} == {("a-b", "/a/b"), ("q", "/q"), ("z", "/z")}
