"""Queries over transcripts: messages, sessions, launch labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.text import human_size
from sessionloom.operators import launch
from sessionloom.operators.sessions import sessions
from sessionloom.plans import native
from sessionloom.plans.tables import table
from sessionloom.sources import codex, cursor
from sessionloom.sources.dialect import messages, read_events
from sessionloom.sources.files import decode_lines, quarantine
from sessionloom.sources.registry import DIALECTS, union_all

ENCODERS = {
    "claude_code": (native.claude_lines, "/data/projects"),
    "codex": (native.codex_lines, "/data/sessions"),
    "cursor": (native.cursor_lines, "/data/cursor"),
    "pi": (native.pi_lines, "/data/pi/sessions"),
}


def messages_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation written in all four dialects and read back as messages."""
    talk = table(spark, folder, "conversations")
    read = [
        messages(read_events(decode_lines(encode(talk)), DIALECTS[source])) for source, (encode, _) in ENCODERS.items()
    ]
    return union_all(read).select("source", "conv_id", F.floor(F.col("seq") / 1000).alias("turn"), "role", "text")


def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row per transcript of each dialect: ids, parent, directory, first message, count."""
    talk = table(spark, folder, "conversations")
    parts = []
    for source, (encode, root) in ENCODERS.items():
        lines = encode(talk)
        events = read_events(decode_lines(lines), DIALECTS[source])
        parts.append(sessions(native.inventory(lines), events, DIALECTS[source], root))
    return union_all(parts).select("source", "id", "parent", "is_subagent", "cwd", "first_message", "message_count")


def session_sizes_human(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    size = F.col("n_chars") * F.pow(F.lit(7), F.col("doc_id") % 13).cast("bigint")
    return docs.select("doc_id", size.alias("size_bytes"), human_size(size).alias("size_human"))


def line_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are no JSON object, by reason, over all dialects."""
    talk = table(spark, folder, "conversations")
    lines = union_all([encode(talk).withColumn("source", F.lit(s)) for s, (encode, _) in ENCODERS.items()])
    return quarantine(lines).groupBy("source", "reason").agg(F.count("*").alias("lines"))


def legacy_text_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Documents rendered as plain-text transcripts with one turn per line."""
    docs = table(spark, folder, "documents")
    rendered = F.concat(F.lit("Human: "), F.replace("text", F.lit("\n"), F.lit("\nAssistant:\n")))
    texts = docs.select("doc_id", rendered.alias("text"))
    turns = cursor.text_events(texts)
    return turns.select("doc_id", F.col("seq").alias("turn"), "role", "text")


def codex_session_class(spark: SparkSession, folder: str) -> DataFrame:
    """Header tag of each session: class and spawning thread."""
    talk = table(spark, folder, "conversations")
    decoded = decode_lines(native.codex_lines(talk)).where(F.expr("variant_get(v, '$.type', 'string') = 'session_meta'"))
    v = F.col("v")
    return decoded.select(
        "conv_id",
        codex.session_class(F.try_variant_get(v, "$.payload.source", "variant")).alias("class"),
        codex.parent_thread(v).alias("parent_thread"),
    )


def _launch_labels(talk: DataFrame) -> DataFrame:
    return launch.own_launch_kind(decode_lines(native.marked_claude_lines(talk)), ["conv_id"])


def launch_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Label per session from event markers and, for the header dialect, from its tag and originator."""
    talk = table(spark, folder, "conversations")
    kind = F.col("conv_id") % 4
    headed = native.codex_lines(
        talk,
        tag=F.when(kind == 0, '"cli"').when(kind == 1, '"exec"').otherwise('"unknown"'),
        originator=F.when(kind == 0, F.when(F.col("conv_id") % 8 == 0, "my-sdk-host").otherwise("other")).when(
            kind == 2, "codex_vscode").otherwise("other"),
    )
    by_header = launch.own_launch_kind(decode_lines(headed), ["conv_id"]).withColumn("source", F.lit("codex"))
    by_event = _launch_labels(talk).withColumn("source", F.lit("claude_code"))
    return by_event.unionByName(by_header).select("source", "conv_id", F.col("own_kind").alias("launch_kind"))


def launch_inherit(spark: SparkSession, folder: str) -> DataFrame:
    """Unlabelled children take the label of their direct parent."""
    labels = _launch_labels(table(spark, folder, "conversations"))
    family = labels.select(
        F.lit("claude_code").alias("source"), F.col("conv_id").alias("id"), "own_kind",
        F.when(F.col("conv_id") % 3 != 0, F.col("conv_id") - F.col("conv_id") % 3).alias("parent"),
    )
    return launch.inherit_launch_kind(family).select(F.col("id").alias("conv_id"), "parent", "own_kind", "launch_kind")


QUERIES = {
    "messages_roundtrip": messages_roundtrip,
    "session_summary": session_summary,
    "session_sizes_human": session_sizes_human,
    "line_quarantine": line_quarantine,
    "legacy_text_turns": legacy_text_turns,
    "codex_session_class": codex_session_class,
    "launch_kind": launch_kind,
    "launch_inherit": launch_inherit,
}

_ORACLE_TEXT = """
      CASE WHEN turn % 2 = 0 THEN text
           WHEN s.source = 'claude_code' THEN text || chr(10) || '[Tool: Bash]' || chr(10) || '[Tool Result]'
           WHEN s.source = 'codex' THEN text
           WHEN s.source = 'cursor' THEN concat_ws(chr(10), nullif(text, ''), '[Tool: edit]')
           ELSE text || chr(10) || '[thinking]' || chr(10) || '[Tool: grep]' || chr(10) || '[image]' END"""

ORACLE_FLAT = f"""
  SELECT s.source, conv_id, turn, role, {_ORACLE_TEXT} AS text
  FROM conversations, (VALUES ('claude_code'), ('codex'), ('cursor'), ('pi')) s(source)
  WHERE NOT (s.source = 'claude_code' AND role = 'system')"""

_CODEX_CLASS = """CASE conv_id % 7 WHEN 3 THEN 'drop' WHEN 4 THEN 'drop' WHEN 5 THEN 'task' WHEN 6 THEN 'task' ELSE 'top' END"""

CLAUDE_KIND = """CASE conv_id % 5 WHEN 0 THEN CASE WHEN max(turn) > 0 THEN 'human' ELSE 'programmatic' END
    WHEN 1 THEN 'programmatic' WHEN 2 THEN 'programmatic' WHEN 3 THEN 'human' ELSE 'unknown' END"""

ORACLES = {
    "messages_roundtrip": ORACLE_FLAT,
    "session_summary": f"""
  WITH m AS ({ORACLE_FLAT}),
  clean AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM m),
  g AS (SELECT c.source, c.conv_id,
          count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n,
          arg_min(CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END, turn)
            FILTER (WHERE role = 'user' AND t <> '') AS first
        FROM clean c GROUP BY 1, 2)
  SELECT source,
    CASE source WHEN 'claude_code' THEN 's' || conv_id WHEN 'cursor' THEN 'c' || conv_id WHEN 'pi' THEN 'pi-' || conv_id
      ELSE printf('00000000-0000-4000-8000-%012d', conv_id) END AS id,
    CASE WHEN source = 'codex' AND conv_id % 7 = 5 THEN 'p1'
         WHEN source = 'pi' AND conv_id % 3 <> 0 THEN 'pi-' || (conv_id - conv_id % 3) END AS parent,
    (source = 'codex' AND conv_id % 7 IN (5, 6)) OR (source = 'pi' AND conv_id % 3 <> 0) AS is_subagent,
    CASE WHEN source <> 'cursor' THEN '/srv/u' || (conv_id % 7) || '/repo' END AS cwd,
    coalesce(first, '(empty session)') AS first_message, n::INTEGER AS message_count
  FROM g WHERE NOT (source = 'codex' AND {_CODEX_CLASS} = 'drop')""",
    "session_sizes_human": """
  WITH s AS (SELECT doc_id, n_chars * (7 ** (doc_id % 13))::BIGINT AS b FROM documents)
  SELECT doc_id, b AS size_bytes,
    CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE)
         WHEN b / 1024.0 < 1024 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
         WHEN b / 1048576.0 < 1024 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
         WHEN b / 1073741824.0 < 1024 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE)
         ELSE printf('%.1f TB', b / 1099511627776.0::DOUBLE) END AS size_human FROM s""",
    "line_quarantine": """
  SELECT s.source, r.reason, (r.per_turn * (SELECT count(*) FROM conversations WHERE turn % 2 = 1))::BIGINT AS lines
  FROM (VALUES ('claude_code'), ('codex'), ('cursor'), ('pi')) s(source),
       (VALUES ('not an object', 3), ('not parsable', 4)) r(reason, per_turn)""",
    "legacy_text_turns": """
  WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
  kept AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13) || chr(160)) AS text FROM lines)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS turn,
         CASE WHEN n = 1 THEN 'user' ELSE 'assistant' END AS role, text
  FROM kept WHERE text <> ''""",
    "codex_session_class": f"""
  SELECT conv_id, {_CODEX_CLASS} AS class, CASE WHEN conv_id % 7 = 5 THEN 'p1' END AS parent_thread
  FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "launch_kind": f"""
  SELECT 'claude_code' AS source, conv_id, {CLAUDE_KIND} AS launch_kind FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'codex', conv_id,
    CASE conv_id % 4 WHEN 0 THEN CASE WHEN conv_id % 8 = 0 THEN 'programmatic' ELSE 'human' END
      WHEN 1 THEN 'programmatic' WHEN 2 THEN 'human' ELSE 'unknown' END
  FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "launch_inherit": f"""
  WITH own AS (SELECT conv_id, {CLAUDE_KIND} AS own_kind,
                 CASE WHEN conv_id % 3 <> 0 THEN conv_id - conv_id % 3 END AS parent
               FROM conversations GROUP BY conv_id)
  SELECT c.conv_id, c.parent, c.own_kind,
    CASE WHEN c.own_kind <> 'unknown' THEN c.own_kind ELSE coalesce(p.own_kind, 'unknown') END AS launch_kind
  FROM own c LEFT JOIN own p ON p.conv_id = c.parent""",
}
