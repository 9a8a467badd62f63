"""Transcripts of sessions/--<folder>--/<time>_<id>.jsonl and run-N/session.jsonl below a parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import variants as V
from sessionloom.functions.text import path_stem
from sessionloom.sources.claude_code import tool_mark
from sessionloom.sources.dialect import Dialect, Layout, header


def _is_message(v: Column) -> Column:
    return F.coalesce(V.string(v, "$.type") == "message", F.lit(False))


def _role(v: Column) -> Column:
    named = V.field(v, "$.message.role")
    return F.when(_is_message(v), F.when(named.isNull(), "user").otherwise(V.shown(named)))


def _named_role(v: Column) -> Column:
    return V.string(v, "$.message.role")


def block_text(v: Column) -> Column:
    def shown(block: Column) -> Column:
        kind = V.string(block, "$.type")
        return (
            F.when(V.is_string(block), block.cast("string"))
            .when(kind == "text", F.coalesce(V.shown(V.field(block, "$.text")), F.lit("")))
            .when(kind == "thinking", F.lit("[thinking]"))
            .when(kind == "toolCall", tool_mark(V.field(block, "$.name")))
            .when(kind == "image", F.lit("[image]"))
        )

    return V.content_text(v, "$.message.content", shown)


def short_id(stem: Column) -> Column:
    """The id behind the first underscore of `<time>_<id>`; the whole stem without one."""
    return F.regexp_replace(stem, r"^[^_]*_", "")


def _header(v: Column, raw: Column) -> Column:
    forked = F.nullif(V.string(v, "$.parentSession"), F.lit(""))
    full = header(
        task=forked.isNotNull(),
        id=F.nullif(V.string(v, "$.id"), F.lit("")),
        parent=short_id(path_stem(forked)),
        cwd=F.nullif(V.string(v, "$.cwd"), F.lit("")),
    )
    return F.when(V.string(v, "$.type") == "session", full).otherwise(header(accepted=F.lit(False)))


def discover(files: DataFrame, root: str) -> DataFrame:
    """Normal sessions, task runs and flat files beside the sessions folder.

    One file can fit two layouts; the run layout decides, and flat files count
    only where nothing else matched.
    """
    inside = F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))
    agent = root.rsplit("/", 1)[0]
    beside = F.substring(F.col("path"), F.lit(len(agent) + 2), F.length("path"))
    under = F.startswith("path", F.lit(root + "/"))
    run = under & inside.rlike(r"(^|/)run-[^/]*/session\.jsonl$")
    normal = under & inside.rlike(r"^--[^/]*--/[^/]+\.jsonl$")
    flat = F.startswith("path", F.lit(agent + "/")) & beside.rlike(r"^[^/]+\.jsonl$")
    run_id = F.concat_ws("-", F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 3),
                         F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2))
    return (
        files.where(run | normal | flat)
        .withColumn("run_session", run)
        .withColumn("folder", F.lit(None).cast("string"))
        .withColumn("path_parent", F.when(run, short_id(F.split_part(inside, F.lit("/"), F.lit(1)))))
        .withColumn("path_id", F.when(run, run_id).otherwise(short_id(path_stem(F.col("path")))))
    )


PI = Dialect(
    id="pi",
    label="Pi",
    source_format="pi-session-jsonl-v3",
    role=_role,
    text=block_text,
    counts=lambda v, role: _is_message(v) & F.coalesce(_named_role(v).isin("user", "assistant"), F.lit(False)),
    opens=lambda v, role: _is_message(v) & F.coalesce(_named_role(v) == "user", F.lit(False)),
    header=_header,
    header_required=True,
    discover=discover,
    layout=Layout(beside=("*.jsonl",)),
)
