"""Queries over session files: tables written as transcripts below the shared folder and scanned again."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import variants as V
from sessionloom.operators import attachments as att
from sessionloom.plans import native, reading
from sessionloom.plans.reading import ENCODERS
from sessionloom.plans.tables import shared_folder, table
from sessionloom.sources.dialect import Dialect, Layout
from sessionloom.sources.registry import DIALECTS, register, union_all
from sessionloom.sources.scan import CorpusScan, scan_messages, scan_sessions

SCANNED = tuple(ENCODERS)  # a conversation's id decides in which of these it is written


SHARDS = 256  # folders that transcripts are dealt to below the others


def _write(lines: DataFrame, keys: list[str], folder: str) -> None:
    """One file per transcript, in `shard=<n>/<key>=<value>` folders, the last key innermost; a transcript's lines are
    written by one task, in order.

    A shard belongs to one task: the commit moves it as a whole, not file by file, and a listing takes up shards, not files.
    Keys that can be NULL would be sorted again by the write, and the order of lines lost.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = lines.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    dealt = named.withColumn("shard", F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int"), F.lit(0)))
    folders = [*keys[:-1], "shard", keys[-1]]
    placed = dealt.repartition(tasks, "shard").sortWithinPartitions(*folders, "seq")
    placed.select(*folders, F.col("raw").alias("value")).write.partitionBy(*folders).text(folder)


def _written(source: str, native_root: str) -> Dialect:
    """The dialect over files as Spark names them: the folder `path=...` holds the transcript's own path."""
    dialect = DIALECTS[source]

    def discover(files: DataFrame, root: str) -> DataFrame:
        own = F.url_decode(F.regexp_extract("path", r"/path=([^/]+)/[^/]+$", 1))
        found = dialect.discover(files.withColumns({"stored": F.col("path"), "path": own}), native_root)
        return found.withColumn("path", F.col("stored")).drop("stored")

    return replace(dialect, layout=Layout(lines="part-*.txt"), discover=discover)


def _encoded(talk: DataFrame) -> DataFrame:
    """Every conversation as the lines of one dialect."""
    turn = F.pmod("conv_id", F.lit(len(SCANNED)))
    parts = []
    for k, source in enumerate(SCANNED):
        encode = native.marked_claude_lines if source == "claude_code" else ENCODERS[source][0]
        parts.append(encode(talk.where(turn == k)).withColumn("source", F.lit(source)))
    return union_all(parts)


def _with_messages(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Session rows with what their messages come to; the last text tells whether lines kept their order."""
    said = messages.groupBy("source", "path").agg(
        F.count("*").alias("messages"), F.sum(F.length("text")).alias("characters"),
        F.sha2(F.max_by("text", "seq").cast("binary"), 256).alias("last_text"),
    )
    return rows.join(said, ["source", "path"], "left")


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation written to a file in one of four dialects; sessions, launch labels and messages read back."""
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    _write(_encoded(table(spark, folder, "conversations")), ["source", "path"], base)
    scans = [
        CorpusScan(spark, _written(s, root), f"{base}/source={s}").kept(f"{base}-lines/{s}") for s, (_, root) in ENCODERS.items()
    ]
    rows = _with_messages(union_all([s.sessions() for s in scans]), union_all([s.messages() for s in scans]))
    return rows.select(
        "source", "id", "parent", "is_subagent", "cwd", "first_message", "message_count", "own_kind",
        "messages", "characters", "last_text",
    )


def _activity_discover(files: DataFrame, root: str) -> DataFrame:
    user = F.regexp_extract("path", r"/user_id=([^/]+)/[^/]+$", 1)
    none = F.lit(None).cast("string")
    found = files.where(F.startswith("path", F.lit(root + "/")) & (user != ""))
    return found.withColumns({"folder": none, "path_parent": none, "path_id": user, "run_session": F.lit(False)})


def _activity_pointers(lines: DataFrame) -> DataFrame:
    found = F.posexplode(att.marker_pointers(F.col("raw"), "/logs/"))
    rows = lines.select(F.col("path").alias("session"), "seq", found.alias("at", "pointer"))
    return rows.select(
        "session", "pointer", F.lit("logs").alias("kind"), F.struct(F.lit(0).alias("phase"), "seq", "at").alias("place")
    )


def _actor(v: Column) -> Column:
    return V.string(v, "$.actor")


ACTIVITY = Dialect(
    id="activity",
    label="Activity",
    source_format="activity-lines",
    role=_actor,
    text=lambda v: F.coalesce(V.string(v, "$.said"), F.lit("")),
    counts=lambda v, role: F.coalesce(role != "error", F.lit(False)),
    opens=lambda v, role: F.coalesce(role == "click", F.lit(False)),
    cwd=lambda v, raw: V.string(v, "$.from"),
    discover=_activity_discover,
    layout=Layout(lines="part-*.txt"),
    attachments=_activity_pointers,
)


def custom_dialect(spark: SparkSession, folder: str) -> DataFrame:
    """Events as transcripts of a dialect registered here, a user's events in one file: its sessions, messages and pointers."""
    register(ACTIVITY)
    base = f"{shared_folder(spark)}/activity-{uuid.uuid4().hex}"
    log = F.format_string("wrote /srv/logs/%d.txt and /srv/logs/%d.txt, %s", F.col("event_id"), F.col("event_id") % 50, F.col("props"))
    line = F.to_json(
        F.struct(
            F.col("event_type").alias("actor"), log.alias("said"), F.concat(F.lit("/srv/u"), F.col("user_id") % 7).alias("from"),
            F.when(F.col("event_type") == "purchase", "typed").alias("promptSource"),
        )
    )
    events = table(spark, folder, "events")
    _write(events.select("user_id", F.col("event_id").alias("seq"), line.alias("raw")), ["user_id"], base)
    scan = CorpusScan(spark, ACTIVITY.id, base).kept(f"{base}-lines")
    roots = {ACTIVITY.id: scan}
    rows = _with_messages(scan_sessions(spark, roots), scan_messages(spark, roots))
    pointers = scan.pointers().groupBy(F.col("session").alias("path")).agg(
        F.count("*").alias("pointers"), F.count_distinct("pointer").alias("targets")
    )
    return rows.join(pointers, "path", "left").select(
        "source", "id", "cwd", "first_message", "message_count", "own_kind", "messages", "characters", "last_text", "pointers", "targets"
    )


QUERIES = {"corpus_files": corpus_files, "custom_dialect": custom_dialect}

# The SQL that the other queries over these dialects are checked by, held to one dialect for each conversation.
_FLAT = f"""
  SELECT * FROM ({reading.ORACLE_FLAT}) WHERE source = CASE conv_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'cursor' ELSE 'pi' END"""

ORACLES = {
    "corpus_files": f"""
  WITH s AS ({reading.ORACLES['session_summary']}),
  m AS (SELECT source, conv_id, count(*) AS messages, sum(length(text))::BIGINT AS characters, sha256(arg_max(text, turn)) AS last_text
        FROM ({_FLAT}) GROUP BY 1, 2),
  k AS (SELECT conv_id, {reading.CLAUDE_KIND} AS kind FROM conversations GROUP BY conv_id)
  SELECT m.source, s.id, s.parent, s.is_subagent, s.cwd, s.first_message, s.message_count,
    CASE m.source WHEN 'claude_code' THEN k.kind WHEN 'codex' THEN CASE m.conv_id % 7 WHEN 1 THEN 'programmatic' ELSE 'human' END
      ELSE 'unknown' END AS own_kind,
    m.messages, m.characters, m.last_text
  FROM m JOIN k USING (conv_id) JOIN s ON s.source = m.source AND s.id = CASE m.source WHEN 'claude_code' THEN 's' || m.conv_id
    WHEN 'cursor' THEN 'c' || m.conv_id WHEN 'pi' THEN 'pi-' || m.conv_id ELSE printf('00000000-0000-4000-8000-%012d', m.conv_id) END""",
    "custom_dialect": """
  WITH e AS (
    SELECT *, 'wrote /srv/logs/' || event_id || '.txt and /srv/logs/' || (event_id % 50) || '.txt, ' || props AS said FROM events)
  SELECT 'activity' AS source, user_id::VARCHAR AS id, '/srv/u' || (user_id % 7) AS cwd,
    coalesce(arg_min(said, event_id) FILTER (WHERE event_type = 'click'), '(empty session)') AS first_message,
    (count(*) FILTER (WHERE event_type <> 'error'))::INTEGER AS message_count,
    CASE WHEN bool_or(event_type = 'purchase') THEN 'human' ELSE 'unknown' END AS own_kind,
    count(*) AS messages, sum(length(said))::BIGINT AS characters, sha256(arg_max(said, event_id)) AS last_text,
    2 * count(*) AS pointers,
    (SELECT count(DISTINCT n) FROM (
       SELECT event_id AS n, user_id AS u FROM events UNION ALL SELECT event_id % 50, user_id FROM events) WHERE u = e.user_id) AS targets
  FROM e GROUP BY user_id""",
}
