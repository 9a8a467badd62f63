"""Incremental runs over real files: only what changed is published again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import attachments as A
from sessionloom.operators import package
from sessionloom.operators import status as st
from sessionloom.sources.files import file_inventory, read_texts
from sessionloom.sources.scan import CorpusScan
from sessionloom.sources.store import current_bundles
from sessionloom.streaming import sync


@pytest.fixture()
def world(spark, tmp_path):
    root, store = tmp_path / "projects", str(tmp_path / "store")
    folder = root / "-srv-app"
    (folder / "s1/tool-results").mkdir(parents=True)
    (folder / "s1/subagents").mkdir()

    def write(name, *texts):
        lines = [json.dumps({"type": "user", "cwd": "/srv/app", "promptSource": "typed", "message": {"content": t}}) for t in texts]
        (folder / name).write_text("\n".join(lines) + "\n")

    write("s1.jsonl", f"mail jo@host.org see {folder}/s1/tool-results/out.txt")
    write("s2.jsonl", "password: 'hunter2hunter2'")
    write("s1/subagents/agent-k.jsonl", "child")
    (folder / "s1/tool-results/out.txt").write_text("/home/alice/secret place")

    def scan():
        return CorpusScan(spark, "claude_code", str(root))

    def describe(changed):
        rows = scan().sessions().join(changed.select("path"), "path", "left_semi")
        return rows.withColumns({"project_label": F.lit("app"), "project_directory": F.lit("/srv/app")})

    def contents(paths):
        return scan().texts().select("path", "content").join(paths, "path", "left_semi")

    def attachments(selected):
        files = read_texts(spark, f"{root}/*/*/tool-results/*").withColumns({"real_path": F.col("path"), "is_file": F.lit(True)})
        pointers = A.claude_pointers(scan().lines())
        owned = A.folder_pointers(A.owned_folders(selected), files, "tool-results", pointers)
        found = A.attach(pointers.unionByName(owned), files, A.fixed_roots([(str(root), str(root))]))
        return found.join(files.select("path", "content", "modified"), "path", "left")

    plan = sync.SyncPlan(
        store=store, contributor="me", describe=describe, contents=contents, attachments=attachments,
        signatures=lambda: scan().files().unionByName(file_inventory(spark, f"{root}/*/*/tool-results/*")), salt=b"0" * 16,
    )

    def tick():
        scan().files().write.mode("append").parquet(f"{tmp_path}/changes")
        sync.start(spark, plan, f"{tmp_path}/changes", f"{tmp_path}/progress").awaitTermination()
        return sync.Tables(spark, store)

    return write, tick, plan, folder, tmp_path


def test_publish_change_and_replay(spark, world, monkeypatch):
    write, tick, plan, folder, tmp = world
    tables = tick()
    state = {r.session: r for r in tables.state.read().collect()}
    assert {(s, r.state) for s, r in state.items()} == {("s1", "current"), ("s2", "current"), ("agent-k", "current")}
    assert all(len(r.source_hash) == 64 for r in state.values())
    bundles = {(r.key.split("/")[-1], r.member_name): r.content for r in current_bundles(tables.members.read()).collect()}
    assert "[EMAIL]" in bundles["claude_code--s1.zip", "transcript.jsonl"]
    assert bundles["claude_code--s1.zip", "tool-results/out.txt"] == "/home/[USER]/secret place"
    assert "hunter2" not in bundles["claude_code--s2.zip", "transcript.jsonl"]
    child = json.loads(bundles["claude_code--agent-k.zip", "manifest.json"])
    assert child["parent_id"] == "claude_code--s1" and child["launch_kind"] == "human"
    assert json.loads(bundles["claude_code--s1.zip", "manifest.json"])["redaction"]["count"] == 2

    # Seen again without a change, then with one.
    tables = tick()
    runs = {r.batch_id: r for r in tables.runs.read().collect()}
    assert (runs[0].sessions_uploaded, runs[1].sessions_uploaded) == (3, 0)
    assert runs[1].last_uploaded_at == runs[0].last_uploaded_at and runs[1].status == "completed"
    write("s2.jsonl", "password: 'hunter2hunter2'", "more")
    tables = tick()
    artifacts = spark.read.parquet(f"{plan.store}/artifacts").where("batch_id = 2").collect()
    assert [r.id for r in artifacts] == ["s2"]

    # Running the last batch again replaces it and adds nothing.
    def rows():
        return sorted(map(tuple, tables.members.read().select("key", "member_name", "content", "batch_id").collect()))

    before = rows()
    sync.run_batch(plan, spark.read.parquet(f"{tmp}/changes"), 2, spark)
    assert rows() == before

    # A new policy version alone publishes everything again.
    monkeypatch.setattr(st, "REDACTION_VERSION", 2)
    sync.run_batch(plan, spark.read.parquet(f"{tmp}/changes").limit(0), 3, spark)
    assert {r.id for r in spark.read.parquet(f"{plan.store}/artifacts").where("batch_id = 3").collect()} == {"s1", "s2", "agent-k"}


def test_one_bundle_for_a_repeated_id(spark, world):
    write, tick, plan, folder, tmp = world
    other = tmp / "projects" / "-srv-app-worktree"
    other.mkdir()
    (other / "s1.jsonl").write_text((folder / "s1.jsonl").read_text() + "\n")
    for _ in range(2):
        tables = tick()
        assert tables.objects.read().count() == 3 and tables.state.read().count() == 4
        members = tables.members.read()
        assert members.count() == members.select("key", "member_name").distinct().count()
    assert spark.read.parquet(f"{plan.store}/artifacts").count() == 3


def test_an_edited_attachment_is_published_again(spark, world):
    write, tick, plan, folder, tmp = world
    tick()
    before = (folder / "s1/tool-results/out.txt").stat()
    (folder / "s1/tool-results/out.txt").write_text("/home/alice/public! place")
    assert (folder / "s1/tool-results/out.txt").stat().st_size == before.st_size + 1
    (folder / "s1/tool-results/out.txt").write_text("/home/alice/openly place")
    os.utime(folder / "s1/tool-results/out.txt", (before.st_atime, before.st_mtime + 5))
    tables = tick()
    assert [r.id for r in spark.read.parquet(f"{plan.store}/artifacts").where("batch_id = 1").collect()] == ["s1"]
    bundles = {r.member_name: r.content for r in current_bundles(tables.members.read()).collect() if "s1.zip" in r.key}
    assert bundles["tool-results/out.txt"] == "/home/[USER]/openly place"
    staged = spark.read.parquet(f"{plan.store}/work/attached")
    assert "content" not in staged.columns


def test_refused_uploads_stay_candidates(world):
    write, tick, plan, folder, tmp = world
    calls = []

    def publish(artifacts, members, batch_id):
        calls.append({r.id for r in artifacts.collect()})
        assert members.select("key").distinct().count() == len(calls[-1])
        tried = artifacts.withColumn("error", F.when(F.col("id") == "s1", "full"))
        # The child gives no outcome at first; a foreign path says nothing.
        kept = tried.where((F.col("id") != "agent-k") | F.lit(batch_id > 0))
        answers = kept.select("path", F.when(F.lit(batch_id < 2), F.col("error")).alias("error"))
        return answers.unionByName(answers.limit(1).withColumns({"path": F.lit("elsewhere"), "error": F.lit("x")}))

    object.__setattr__(plan, "publish", publish)
    tables = tick()
    assert calls == [{"s1", "s2", "agent-k"}]
    assert {r.session: r.state for r in tables.state.read().collect()} == {"s1": "not_uploaded", "s2": "current", "agent-k": "not_uploaded"}
    assert {r.session: r.error for r in tables.errors.read().collect()} == {"s1": "full", "agent-k": package.UNANSWERED}
    assert [r.session for r in tables.results.read().collect()] == ["s2"]
    run = tables.runs.read().first()
    assert (run.status, run.sessions_uploaded, run.errors) == ("partial", 1, 2)
    assert current_bundles(tables.members.read(), tables.results.read()).select("key").distinct().count() == 1

    tables = tick()
    assert calls[1:] == [{"s1", "agent-k"}]
    tables = tick()
    assert calls[2:] == [{"s1"}]
    assert {r.state for r in tables.state.read().collect()} == {"current"}
    sizes = {r.object_key: r.bundle_bytes for r in tables.results.read().collect()}
    held = current_bundles(tables.members.read(), tables.results.read()).groupBy("key").agg(F.sum(F.octet_length("content")).alias("n"))
    assert {r.key: r.n for r in held.collect()} == sizes and len(sizes) == 3
    tick()
    assert calls[3:] == [set()]
