"""One row per transcript: identity, size, first message, message count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import EMPTY_SESSION, human_size
from sessionloom.operators.launch import UNKNOWN, rollup
from sessionloom.sources.dialect import Dialect, summary_columns, summary_input
from sessionloom.sources.registry import scan_rank


def summarize(events: DataFrame) -> DataFrame:
    """Per path: message count, first user message, first working directory, header.

    Events with a `verdict` give the launch label `own_kind` in the same pass."""
    rows = summary_input(events)
    label = [rollup(F.col("verdict")).alias("own_kind")] if "verdict" in rows.columns else []
    return rows.groupBy("path").agg(*summary_columns(), *label)


def sessions(files: DataFrame, events: DataFrame, dialect: Dialect, root: str) -> DataFrame:
    """Transcripts of one dialect: what the path says joined with what the lines say.

    Files without a usable line stay as empty sessions unless the dialect needs a
    header. `ordinal` sorts sessions the way a scan would meet them.
    """
    found = dialect.discover(files, root).join(summarize(events), "path", "left")
    kept = found.where(F.coalesce(F.col("header.accepted"), F.lit(not dialect.header_required)))
    parent = F.coalesce("path_parent", F.col("header.parent"))
    label = [F.coalesce("own_kind", F.lit(UNKNOWN)).alias("own_kind")] if "own_kind" in kept.columns else []
    return kept.select(
        F.lit(dialect.id).alias("source"),
        F.coalesce(F.col("header.id"), F.col("path_id")).alias("id"),
        parent.alias("parent"),
        (F.col("path_parent").isNotNull() | F.col("run_session") | F.coalesce(F.col("header.task"), F.lit(False))).alias(
            "is_subagent"
        ),
        "path",
        F.col("size").alias("size_bytes"),
        "modified",
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.coalesce("first_message", F.lit(EMPTY_SESSION)).alias("first_message"),
        F.coalesce("cwd", F.col("header.cwd")).alias("cwd"),
        "folder",
        F.struct(
            F.lit(scan_rank(dialect.id)).alias("rank"),
            F.coalesce("folder", F.lit("")).alias("folder"),
            F.col("path_parent").isNotNull().alias("child"),
            F.split("path", "/").alias("parts"),
        ).alias("ordinal"),
        *label,
    )


def session_view(rows: DataFrame) -> DataFrame:
    """The columns shown for a session, with a readable size."""
    return rows.select(
        "source", "id", "project_id", "first_message", "message_count", "size_bytes",
        human_size(F.col("size_bytes")).alias("size_human"), "modified", "is_subagent", "parent",
    )
