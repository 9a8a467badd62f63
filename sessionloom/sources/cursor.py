"""Transcripts below <folder>/agent-transcripts: JSON lines, or plain text with role lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import variants as V
from sessionloom.functions.text import WHITESPACE_CLASS, let, path_name, path_stem, path_suffix, strip, unify_line_breaks
from sessionloom.operators.attachments import cursor_pointers
from sessionloom.sources.dialect import Dialect, Layout

ROLES = ("user", "assistant", "system")
TRANSCRIPTS = "agent-transcripts"


def _role(v: Column) -> Column:
    role = V.string(v, "$.role")
    return F.when(role.isin(*ROLES), role)


def block_text(v: Column) -> Column:
    """Content of the message object, or of the line itself when there is none."""

    def shown(block: Column) -> Column:
        kind = V.string(block, "$.type")
        name = F.coalesce(
            F.nullif(V.string(block, "$.name"), F.lit("")), F.nullif(V.string(block, "$.toolName"), F.lit("")), F.lit("?")
        )
        return (
            F.when(V.is_string(block), block.cast("string"))
            .when(kind == "text", F.coalesce(V.shown(V.field(block, "$.text")), F.lit("")))
            .when(kind == "tool_use", F.concat(F.lit("[Tool: "), name, F.lit("]")))
        )

    nested = V.is_object(V.field(v, "$.message"))
    holder = F.when(nested, V.field(v, "$.message")).otherwise(v)
    return let(holder, lambda h: V.content_text(h, "$.content", shown, keep_empty=False))


# A role line: the bare word, or a capitalized word, a colon and the first text.
ROLE_WORDS = ("user", "human", "assistant", "cursor")
_SPACE = rf"[{WHITESPACE_CLASS}&&[^\n]]*"
_ROLE_LINE = rf"(?m)^{_SPACE}(?:(?i:user|human|assistant|cursor):*{_SPACE}|(?:User|Human|Assistant|Cursor):[^\n]*)$\n?"


def text_turns(text: Column) -> Column:
    """array of struct(role, text): each role line opens a turn holding the lines up to the next one.

    A text without any turn is one assistant turn. The whole text is handled in
    its own row, so no line order has to survive a shuffle.
    """

    def turn(line: Column, body: Column) -> Column:
        bare = F.lower(F.rtrim(line, F.lit(":")))
        is_bare = bare.isin(*ROLE_WORDS)
        word = F.when(is_bare, bare).otherwise(F.lower(F.substring_index(line, ":", 1)))
        inline = F.when(is_bare, F.lit("")).otherwise(
            strip(F.substring(line, F.instr(line, ":") + 1, F.length(line)))
        )
        return F.struct(
            F.when(word.isin("user", "human"), "user").otherwise("assistant").alias("role"),
            strip(F.concat(inline, F.lit("\n"), body)).alias("text"),
        )

    def whole(plain: Column) -> Column:
        lines = F.transform(F.regexp_extract_all(plain, F.lit(_ROLE_LINE), F.lit(0)), strip)
        bodies = F.split(plain, _ROLE_LINE, -1)
        paired = F.zip_with(lines, F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), turn)
        single = F.array(F.struct(F.lit("assistant").alias("role"), strip(text).alias("text")))
        return let(
            F.filter(paired, lambda t: t["text"] != ""),
            lambda found: F.when((F.size(found) > 0) | (strip(plain) == ""), found).otherwise(single),
        )

    return let(unify_line_breaks(text), whole)


def holds_json(text: Column) -> Column:
    """Whether any line is a JSON object; stops at the first one."""
    return F.exists(
        F.split(text, "\n"),
        lambda line: F.coalesce(
            F.when(strip(line).startswith("{"), V.is_object(V.document(strip(line)))), F.lit(False)
        ),
    )


def text_events(texts: DataFrame) -> DataFrame:
    """Events of plain-text transcripts; every turn counts as a message."""
    keep = [c for c in texts.columns if c not in ("text", "content", "source")]
    turns = texts.select(*keep, F.posexplode(text_turns(F.col("text"))).alias("seq", "turn"))
    return turns.select(
        F.lit("cursor").alias("source"), *keep, "seq", F.col("turn.role").alias("role"), F.lit(True).alias("counts"),
        (F.col("turn.role") == "user").alias("opens"), F.lit(None).cast("string").alias("cwd"),
        F.col("turn.text").alias("text"),
    )


def discover(files: DataFrame, root: str) -> DataFrame:
    inside = F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))
    parts = F.split(inside, "/")
    return (
        files.where(F.startswith("path", F.lit(root + "/")))
        .where(F.get(parts, F.lit(1)) == TRANSCRIPTS)
        .where(~path_name(F.col("path")).startswith(".") & F.lower(path_suffix(F.col("path"))).isin(".jsonl", ".txt"))
        .withColumn("folder", F.get(parts, F.lit(0)))
        .withColumn("below", F.slice(parts, F.lit(3), F.size(parts)))
        .withColumn("at", F.array_position("below", F.lit("subagents")))
        .withColumn("path_parent", F.when(F.col("at") > 1, F.get("below", F.col("at").cast("int") - 2)))
        .withColumn(
            "path_id",
            F.when((F.col("at") == 0) & (F.size("below") > 1), F.get("below", F.size("below") - 2)).otherwise(
                path_stem(F.col("path"))
            ),
        )
        .withColumn("run_session", F.lit(False))
        .drop("below", "at")
    )


CURSOR = Dialect(
    id="cursor",
    label="Cursor",
    source_format="cursor-agent-transcript",
    role=_role,
    text=block_text,
    counts=lambda v, role: F.coalesce(role.isin("user", "assistant"), F.lit(False)),
    opens=lambda v, role: role == "user",
    discover=discover,
    layout=Layout(lines="*.[jJ][sS][oO][nN][lL]", texts="*.[tT][xX][tT]"),
    attachments=cursor_pointers,
    whole_text=text_turns,
)
