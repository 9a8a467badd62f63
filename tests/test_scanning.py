"""Many small transcripts: written shard by shard, and opened once for all results of a scan."""

from pathlib import Path

from pyspark.sql import functions as F

from sessionloom.plans import scanning
from sessionloom.sources.registry import DIALECTS
from sessionloom.sources.scan import CorpusScan, scan_messages, scan_sessions


def rows(frame):
    return sorted(map(repr, frame.collect()))


def write_codex(spark, folder, sessions):
    """Two turns and a broken line for each session, as `_write` lays out transcripts."""
    turns = spark.range(3 * sessions).select(
        F.format_string("/data/sessions/2026/01/02/rollout-%d.jsonl", F.floor(F.col("id") / 3)).alias("path"),
        (-F.col("id")).alias("seq"),
        F.when(F.col("id") % 3 == 0, "no object").otherwise(
            F.format_string('{"role":"user","content":"said %d"}', "id")
        ).alias("raw"),
    )
    source = F.when(F.col("path") == "", "pi").otherwise("codex")
    scanning._write(turns.withColumn("source", source), ["source", "path"], str(folder))


def test_transcripts_are_files_of_their_own_in_few_shards(spark, tmp_path):
    write_codex(spark, tmp_path / "corpus", 400)
    files = list((tmp_path / "corpus").rglob("part-*.txt"))
    assert len(files) == len({f.parent for f in files}) == 400
    shards = [p for p in (tmp_path / "corpus" / "source=codex").iterdir()]
    assert all(p.name.startswith("shard=") for p in shards) and 100 < len(shards) <= scanning.SHARDS
    assert [line[-7:] for line in files[0].read_text().splitlines()][-1] == " object"  # `seq` falls as ids rise


def test_kept_scan_gives_the_same_results_and_opens_no_file_again(spark, tmp_path):
    write_codex(spark, tmp_path / "corpus", 40)
    dialect = scanning._written("codex", "/data/sessions")
    plain = CorpusScan(spark, dialect, str(tmp_path / "corpus" / "source=codex"))
    kept = plain.kept(str(tmp_path / "lines"))
    for result in ("sessions", "messages"):
        found = rows(getattr(kept, result)().drop("seq"))
        assert found == rows(getattr(plain, result)().drop("seq")) and len(found) in (40, 80)
    assert all(Path(f).parent.name == "lines" for f in kept.messages().inputFiles())
    given = {"codex": kept}
    assert rows(scan_sessions(spark, given)) == rows(kept.sessions()) and "codex" in DIALECTS
    assert rows(scan_messages(spark, given)) == rows(kept.messages())


def test_corpus_files_opens_transcripts_for_their_lines_alone(spark):
    plan = scanning.corpus_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FileScan text" not in plan and "FileScan parquet" in plan
