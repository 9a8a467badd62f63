"""Native transcript lines derived from a table of conversations.

Every conversation is written in the shape of each dialect with Spark
expressions, dirty lines included, so the readers can be run on any table of
(conv_id, turn, role, text). No shuffle: a turn becomes its lines in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRTY = ["", "   ", "not json", "[1,2]", '"text"', '{"a":', '{"a":1,"a":2}', '{"role":"user","content":"x"}{"b":2}', '{"role":"user","content":"x"},{"b":2}', '{"role":"user"} x}']
CODEX_TAGS = (
    '"cli"', '"exec"', '{"custom":"x"}', '{"internal":"memory"}', '{"subagent":"review"}',
    '{"subagent":{"thread_spawn":{"parent_thread_id":"p1"}}}', '{"subagent":{"other":"y"}}',
)


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _text_block(kind: str = "text") -> Column:
    return F.struct(F.lit(kind).alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"))


def _block(kind: str, name: str | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text"), F.lit(name).cast("string").alias("name")
    )


def _odd() -> Column:
    return F.col("turn") % 2 == 1


def _spread(conversations: DataFrame, path: Column, line: Column, header: Column | None = None) -> DataFrame:
    """Lines in file order: the header before the first turn, junk after the second."""
    nothing = F.array().cast("array<string>")
    before = F.when(F.col("turn") == 0, F.array(header)).otherwise(nothing) if header is not None else nothing
    after = F.when(_odd(), F.array(*[F.lit(d) for d in DIRTY])).otherwise(nothing)
    exploded = conversations.select(
        "conv_id", "turn", path.alias("path"), F.posexplode(F.concat(before, F.array(line), after)).alias("at", "raw")
    )
    return exploded.select("conv_id", "path", (F.col("turn") * 1000 + F.col("at")).alias("seq"), "raw")


def claude_lines(conversations: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    blocks = F.array(_text_block(), _block("tool_use", "Bash"), _block("tool_result"), _block("image"))
    common = {"type": F.col("role"), "cwd": F.concat(F.lit("/srv/u"), (F.col("conv_id") % 7).cast("string"), F.lit("/repo"))}
    common |= extra or {}
    plain = _json(**common, message=F.struct(F.col("role"), F.col("text").alias("content")))
    blocked = _json(**common, message=F.struct(F.col("role"), blocks.alias("content")))
    path = F.format_string("/data/projects/-srv-u%d-repo/s%d.jsonl", F.col("conv_id") % 7, F.col("conv_id"))
    return _spread(conversations, path, F.when(_odd(), blocked).otherwise(plain))


def marked_claude_lines(conversations: DataFrame) -> DataFrame:
    """With markers of how each session was started: five cases by id, one of which changes after the first turn."""
    kind, late = F.col("conv_id") % 5, F.col("turn") > 0
    return claude_lines(
        conversations,
        {
            "promptSource": F.when((kind == 0) & late, "typed").when((kind == 1) | ((kind == 0) & ~late), "sdk"),
            "entrypoint": F.when(kind == 2, "sdk-py").when(kind == 3, "cli"),
            "origin": F.when((kind == 2) | (kind == 3), F.struct(F.lit("human").alias("kind"))),
        },
    )


def codex_lines(conversations: DataFrame, tag: Column | None = None, originator: Column | None = None) -> DataFrame:
    blocks = F.array(_text_block("input_text"), _block("refusal"))
    wrapped = _json(
        type=F.lit("response_item"), payload=F.struct(F.col("role"), blocks.alias("content"))
    )
    bare = _json(role=F.col("role"), content=F.col("text"))
    tags = F.array(*[F.lit(t) for t in CODEX_TAGS])
    tag = tag if tag is not None else F.get(tags, (F.col("conv_id") % len(CODEX_TAGS)).cast("int"))
    header = F.concat(
        F.lit('{"type":"session_meta","payload":{"meta":{"cwd":"/srv/u'), F.col("conv_id") % 7, F.lit('/repo"},"originator":"'),
        originator if originator is not None else F.lit("codex-tui"), F.lit('","source":'), tag, F.lit("}}"),
    )
    path = F.format_string(
        "/data/sessions/2026/01/02/rollout-2026-01-02T00-00-00-00000000-0000-4000-8000-%012d.jsonl", F.col("conv_id")
    )
    return _spread(conversations, path, F.when(_odd(), wrapped).otherwise(bare), header)


def cursor_lines(conversations: DataFrame) -> DataFrame:
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("edit").alias("toolName"))
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("toolName"))
    blank = F.struct(F.lit("text").alias("type"), F.lit("").alias("text"), F.lit(None).cast("string").alias("toolName"))
    blocked = _json(role=F.col("role"), message=F.struct(F.array(text, blank, tool).alias("content")))
    plain = _json(role=F.col("role"), content=F.col("text"))
    path = F.format_string("/data/cursor/srv-u%d-repo/agent-transcripts/c%d/t.jsonl", F.col("conv_id") % 7, F.col("conv_id"))
    return _spread(conversations, path, F.when(_odd(), blocked).otherwise(plain))


def pi_lines(conversations: DataFrame) -> DataFrame:
    blocks = F.array(_text_block(), _block("thinking"), _block("toolCall", "grep"), _block("image"), _block("other"))
    plain = _json(type=F.lit("message"), message=F.struct(F.col("role"), F.col("text").alias("content")))
    blocked = _json(type=F.lit("message"), message=F.struct(F.col("role"), blocks.alias("content")))
    header = _json(
        type=F.lit("session"), version=F.lit(3), id=F.concat(F.lit("pi-"), F.col("conv_id")),
        cwd=F.concat(F.lit("/srv/u"), F.col("conv_id") % 7, F.lit("/repo")),
        parentSession=F.when(F.col("conv_id") % 3 != 0, F.format_string("/x/2026_pi-%d.jsonl", F.col("conv_id") - F.col("conv_id") % 3)),
    )
    path = F.format_string("/data/pi/sessions/--srv-u%d-repo--/2026-01-02_pi-%d.jsonl", F.col("conv_id") % 7, F.col("conv_id"))
    return _spread(conversations, path, F.when(_odd(), blocked).otherwise(plain), header)


def inventory(lines: DataFrame) -> DataFrame:
    """files(path, size, modified) as a listing of the encoded lines would give."""
    sized = lines.groupBy("path").agg(
        F.sum(F.octet_length("raw") + 1).alias("size"), F.max("conv_id").alias("conv_id")
    )
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60)
    return sized.select("path", "size", moment.alias("modified"))
