"""Transcripts of projects/<folder>/<id>.jsonl with subagents below the parent's folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import variants as V
from sessionloom.operators.attachments import claude_pointers
from sessionloom.sources.dialect import Dialect

TURN_TYPES = ("user", "assistant")


def _role(v: Column) -> Column:
    kind = V.string(v, "$.type")
    return F.when(kind.isin(*TURN_TYPES), kind)


def block_text(v: Column) -> Column:
    def shown(block: Column) -> Column:
        kind = V.string(block, "$.type")
        return (
            F.when(kind == "text", F.coalesce(V.shown(V.field(block, "$.text")), F.lit("")))
            .when(kind == "tool_use", tool_mark(V.field(block, "$.name")))
            .when(kind == "tool_result", F.lit("[Tool Result]"))
        )

    return V.content_text(v, "$.message.content", shown)


def tool_mark(name: Column) -> Column:
    return F.concat(F.lit("[Tool: "), F.coalesce(V.shown(name), F.lit("?")), F.lit("]"))


def discover(files: DataFrame, root: str) -> DataFrame:
    """Session, parent and folder from the path; files elsewhere are no transcripts."""
    inside = F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))
    top = F.regexp_extract(inside, r"^([^/]+)/([^/]+)\.jsonl$", 2)
    child = F.regexp_extract(inside, r"^([^/]+)/([^/]+)/subagents/([^/]+)\.jsonl$", 3)
    return (
        files.where(F.startswith("path", F.lit(root + "/")))
        .withColumn("folder", F.split_part(inside, F.lit("/"), F.lit(1)))
        .withColumn("path_parent", F.when(child != "", F.split_part(inside, F.lit("/"), F.lit(2))))
        .withColumn("path_id", F.coalesce(F.nullif(top, F.lit("")), F.nullif(child, F.lit(""))))
        .where(F.col("path_id").isNotNull())
        .withColumn("run_session", F.lit(False))
    )


CLAUDE_CODE = Dialect(
    id="claude_code",
    label="Claude Code",
    source_format="claude-jsonl",
    role=_role,
    text=block_text,
    counts=lambda v, role: role.isNotNull(),
    opens=lambda v, role: role == "user",
    cwd=lambda v, raw: V.string(v, "$.cwd"),
    discover=discover,
    attachments=claude_pointers,
)
