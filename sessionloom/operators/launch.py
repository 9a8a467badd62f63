"""How a session was started: by a person, by a program, or unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import variants as V
from sessionloom.operators.joins import lookup

HUMAN = "human"
PROGRAMMATIC = "programmatic"
UNKNOWN = "unknown"

# Markers in transcript events.
HUMAN_PROMPTS = ("typed", "queued")
PROGRAM_PROMPTS = ("sdk",)
PROGRAM_ENTRYPOINTS = ("sdk-cli", "sdk-py", "sdk-ts")
HUMAN_TAGS = ("cli", "vscode")
PROGRAM_TAGS = ("exec", "mcp")
HUMAN_ORIGINATORS = ("codex-tui", "codex_tui", "codex-vscode", "codex_vscode")
PROGRAM_ORIGINATOR_PARTS = ("exec", "mcp", "sdk", "api")


def _header_verdict(v: Column) -> Column:
    """A session header states the start once; an originator marker outweighs the source tag."""
    payload = V.field(v, "$.payload")
    tag = F.lower(F.coalesce(V.shown(V.field(payload, "$.source")), F.lit("")))
    originator = F.lower(F.coalesce(V.shown(V.field(payload, "$.originator")), F.lit("")))
    program = tag.isin(*PROGRAM_TAGS) | originator.rlike("|".join(PROGRAM_ORIGINATOR_PARTS))
    human = tag.isin(*HUMAN_TAGS) | originator.isin(*HUMAN_ORIGINATORS)
    is_header = (V.string(v, "$.type") == "session_meta") & V.is_object(payload)
    return F.when(is_header & program, PROGRAMMATIC).when(is_header & human, HUMAN)


def event_verdict(v: Column) -> Column:
    """What one event says, or NULL. The submission channel is read before the origin."""
    prompt = V.string(v, "$.promptSource")
    return F.coalesce(
        _header_verdict(v),
        F.when(prompt.isin(*PROGRAM_PROMPTS) | V.string(v, "$.entrypoint").isin(*PROGRAM_ENTRYPOINTS), PROGRAMMATIC)
        .when(V.string(v, "$.origin.kind") == HUMAN, HUMAN)
        .when(prompt.isin(*HUMAN_PROMPTS), HUMAN),
    )


def rollup(verdict: Column) -> Column:
    """Any human event makes the session human, else any program event makes it programmatic."""
    return (
        F.when(F.coalesce(F.bool_or(verdict == HUMAN), F.lit(False)), HUMAN)
        .when(F.coalesce(F.bool_or(verdict == PROGRAMMATIC), F.lit(False)), PROGRAMMATIC)
        .otherwise(UNKNOWN)
    )


def own_launch_kind(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Label per transcript from its own events only."""
    return decoded.groupBy(*keys).agg(rollup(event_verdict(F.col("v"))).alias("own_kind"))


def inherit_launch_kind(labelled: DataFrame) -> DataFrame:
    """An unlabelled child takes its direct parent's own label.

    `labelled` has source, id, parent and own_kind. Several sessions can share an
    id; the parent's label is the strongest of theirs. One parent may own most
    sessions, so the join is salted.
    """
    strength = F.when(F.col("own_kind") == HUMAN, 2).when(F.col("own_kind") == PROGRAMMATIC, 1).otherwise(0)
    strongest = F.max(strength)
    parents = labelled.groupBy("source", F.col("id").alias("parent")).agg(
        F.when(strongest == 2, HUMAN).when(strongest == 1, PROGRAMMATIC).otherwise(UNKNOWN).alias("parent_kind")
    )
    joined = lookup(labelled, parents, ["source", "parent"], spread_by=["id"])
    kind = F.when(F.col("own_kind") != UNKNOWN, F.col("own_kind")).otherwise(F.coalesce("parent_kind", F.lit(UNKNOWN)))
    return joined.withColumn("launch_kind", kind).drop("parent_kind")
