"""Transcripts named rollout-<time>-<uuid>.jsonl at any depth."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import variants as V
from sessionloom.functions.text import let, path_name, path_stem
from sessionloom.sources.dialect import Dialect, Layout, header

ROLES = ("user", "assistant", "system")
TEXT_BLOCKS = ("input_text", "output_text", "text")
# Fields that name a working directory and the objects to look into.
CWD_FIELDS = ("cwd", "cwd_path", "working_directory")
CWD_PARENTS = ("payload", "session", "meta", "session_meta")
CWD_LEVELS = 4  # objects looked through by expressions; deeper lines, which are rare, are walked as a whole
_UUID = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


def _node(v: Column) -> Column:
    """The object that carries role and content: the line itself or its payload."""
    return F.when(V.field(v, "$.role").isNull(), V.field(v, "$.payload")).otherwise(v)


def _role(v: Column) -> Column:
    role = V.string(_node(v), "$.role")
    return F.when(role.isin(*ROLES), role)


def block_text(v: Column) -> Column:
    def shown(block: Column) -> Column:
        return F.when(V.is_string(block), block.cast("string")).when(
            V.string(block, "$.type").isin(*TEXT_BLOCKS), F.coalesce(V.shown(V.field(block, "$.text")), F.lit(""))
        )

    return let(_node(v), lambda node: V.content_text(node, "$.content", shown))


def walk_cwd(line: str) -> str | None:
    """The first working directory in a line, an object before what is in it."""
    try:
        waiting = [json.loads(line)]
    except (ValueError, RecursionError):
        return None
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            found = next((node[name] for name in CWD_FIELDS if isinstance(node.get(name), str) and node[name]), None)
            if found is not None:
                return found
            waiting.extend(node[name] for name in reversed(CWD_PARENTS) if name in node)
    return None


def _walked(raw: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def walk(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else walk_cwd(x) for x in lines.to_pylist()], pa.string())

    return walk(raw)


def find_cwd(v: Column, raw: Column) -> Column:
    """The first working directory in the line, own fields before nested ones, at any depth."""
    level = F.array(F.struct(F.lit("").alias("order"), v.alias("node")))
    levels = [level]

    def below(entry: Column) -> Column:
        children = [
            F.when(
                V.is_object(V.field(entry["node"], f"$.{name}")),
                F.struct(
                    F.concat(entry["order"], F.lit(str(i))).alias("order"),
                    V.field(entry["node"], f"$.{name}").alias("node"),
                ),
            )
            for i, name in enumerate(CWD_PARENTS)
        ]
        return F.array_compact(F.array(*children))

    for _ in range(CWD_LEVELS - 1):
        level = F.flatten(F.transform(level, below))
        levels.append(level)

    def own(entry: Column) -> Column:
        values = [F.nullif(V.string(entry["node"], f"$.{name}"), F.lit("")) for name in CWD_FIELDS]
        found = F.coalesce(*values)
        return F.when(found.isNotNull(), F.struct(entry["order"].alias("order"), found.alias("cwd")))

    # Ordering by the path of child positions visits parents before children.
    found = F.array_min(F.array_compact(F.transform(F.concat(*levels), own)))["cwd"]
    named = raw.contains("cwd") | raw.contains("working_directory")
    deeper = named & (F.size(F.flatten(F.transform(level, below))) > 0)
    return F.when(deeper, _walked(F.when(deeper, raw))).otherwise(F.when(named, found))


def session_class(tag: Column) -> Column:
    """top, task or drop from the header's `source`: scaffolding runs are dropped."""
    has = lambda name: V.field(tag, f"$.{name}").isNotNull()
    return (
        F.when(tag.isNull() | ~V.is_object(tag), "top")
        .when(has("custom"), "top")
        .when(has("internal"), "drop")
        .when(has("subagent") & V.is_string(V.field(tag, "$.subagent")), "drop")
        .when(has("subagent"), "task")
        .otherwise("top")
    )


def parent_thread(v: Column) -> Column:
    """The spawning thread, named in the source tag or beside it."""
    body = F.when(V.is_object(V.field(v, "$.payload")), V.field(v, "$.payload")).otherwise(v)
    return let(
        body,
        lambda b: F.coalesce(
            V.string(b, "$.source.subagent.thread_spawn.parent_thread_id"), V.string(b, "$.parent_thread_id")
        ),
    )


def _header(v: Column, raw: Column) -> Column:
    body = F.when(V.is_object(V.field(v, "$.payload")), V.field(v, "$.payload")).otherwise(v)
    full = let(
        session_class(V.field(body, "$.source")),
        lambda kind: header(
            accepted=kind != "drop", task=kind == "task", parent=F.when(kind == "task", parent_thread(v))
        ),
    )
    # Only a line with a source tag can say anything but the default.
    return F.when(raw.contains("source"), full).otherwise(header())


def discover(files: DataFrame, root: str) -> DataFrame:
    stem = path_stem(F.col("path"))
    uuid = F.nullif(F.regexp_extract(stem, _UUID, 1), F.lit(""))
    return (
        files.where(F.startswith("path", F.lit(root + "/")))
        .where(path_name(F.col("path")).rlike(r"^rollout-.*\.jsonl$"))
        .withColumn("folder", F.lit(None).cast("string"))
        .withColumn("path_parent", F.lit(None).cast("string"))
        .withColumn("path_id", F.coalesce(uuid, stem))
        .withColumn("run_session", F.lit(False))
    )


CODEX = Dialect(
    id="codex",
    label="Codex",
    source_format="codex-rollout-jsonl",
    role=_role,
    text=block_text,
    counts=lambda v, role: F.coalesce(role.isin("user", "assistant"), F.lit(False)),
    opens=lambda v, role: role == "user",
    cwd=find_cwd,
    header=_header,
    discover=discover,
    layout=Layout(lines="rollout-*.jsonl"),
)
