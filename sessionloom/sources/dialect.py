"""What a transcript dialect has to say about one decoded line."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import strip, truncate

HEADER_TYPE = "struct<accepted:boolean,task:boolean,id:string,parent:string,cwd:string>"


@dataclass(frozen=True)
class Layout:
    """Which files below a root can be transcripts; `discover` decides by the whole path.

    lines   name glob of the JSON-line files, at any depth
    texts   name glob of files that are read whole, if there are any
    beside  name globs of JSON-line files in the folder that holds the root
    """

    lines: str = "*.jsonl"
    texts: str | None = None
    beside: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dialect:
    """An adapter: column expressions over the VARIANT of one line.

    role, text      the message on this line; a NULL role means there is none
    counts          whether the line counts as a message of the session
    opens           whether its text may serve as the session's first message
    cwd             the working directory named on this line, or NULL
    header_required a file without any object is no transcript
    header          HEADER_TYPE describing the session, read from its first object
    discover        file inventory -> one row per transcript with ids from paths
    layout          which files to read
    attachments     optional: lines(path, seq, raw) -> pointers(session, pointer, kind, place)
    whole_text      optional: text of a whole file -> array of struct(role, text); for files in
                    which no line is a JSON object
    """

    id: str
    label: str
    source_format: str
    role: Callable[[Column], Column]
    text: Callable[[Column], Column]
    counts: Callable[[Column, Column], Column]
    opens: Callable[[Column, Column], Column]
    discover: Callable[[DataFrame, str], DataFrame]
    cwd: Callable[[Column, Column], Column] = lambda v, raw: F.lit(None).cast("string")
    header: Callable[[Column, Column], Column] = lambda v, raw: header()
    header_required: bool = False
    layout: Layout = Layout()
    attachments: Callable[[DataFrame], DataFrame] | None = None
    whole_text: Callable[[Column], Column] | None = None


def header(accepted=None, task=None, id=None, parent=None, cwd=None) -> Column:
    def or_else(value, kind, default=None):
        return (F.lit(default) if value is None else value).cast(kind)

    return F.struct(
        or_else(accepted, "boolean", True).alias("accepted"),
        or_else(task, "boolean", False).alias("task"),
        or_else(id, "string").alias("id"),
        or_else(parent, "string").alias("parent"),
        or_else(cwd, "string").alias("cwd"),
    )


def read_events(decoded: DataFrame, dialect: Dialect, verdict: Column | None = None) -> DataFrame:
    """One row per JSON object line: its message, if any, and what it adds to the session.

    `verdict`, an expression over `v`, is what the line says about how the session was launched."""
    v, raw = F.col("v"), F.col("raw")
    keep = [F.col(c) for c in decoded.columns if c not in ("v", "raw", "source")]
    with_role = decoded.select(*keep, "raw", "v", dialect.role(v).alias("role"))
    role = F.col("role")
    return with_role.select(
        F.lit(dialect.id).alias("source"),
        *keep,
        role,
        F.when(role.isNotNull(), dialect.text(v)).alias("text"),
        dialect.counts(v, role).alias("counts"),
        dialect.opens(v, role).alias("opens"),
        dialect.cwd(v, raw).alias("cwd"),
        dialect.header(v, raw).alias("header"),
        *([] if verdict is None else [verdict.alias("verdict")]),
    )


def messages(events: DataFrame) -> DataFrame:
    return events.where(F.col("role").isNotNull()).drop("counts", "opens", "cwd", "header", "verdict")


def summary_input(events: DataFrame) -> DataFrame:
    """What a summary needs of each event: texts are cut before anything is sorted or shuffled."""
    opening = F.when(F.col("opens") & (strip(F.col("text")) != ""), truncate(F.col("text")))
    verdict = [c for c in events.columns if c == "verdict"]
    return events.select("path", "seq", "counts", "cwd", "header", opening.alias("opening"), *verdict)


def summary_columns() -> list[Column]:
    """Aggregates over summary_input of one transcript; all combine on the map side."""
    return [
        F.count_if(F.col("counts")).cast("int").alias("message_count"),
        F.min_by("opening", F.when(F.col("opening").isNotNull(), F.col("seq"))).alias("first_message"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("seq"))).alias("cwd"),
        F.min_by("header", "seq").alias("header"),
    ]
