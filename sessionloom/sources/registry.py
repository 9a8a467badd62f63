"""The known dialects, in the order in which they are scanned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from sessionloom.sources.claude_code import CLAUDE_CODE
from sessionloom.sources.codex import CODEX
from sessionloom.sources.cursor import CURSOR
from sessionloom.sources.dialect import Dialect
from sessionloom.sources.pi import PI

DIALECTS: dict[str, Dialect] = {d.id: d for d in (CLAUDE_CODE, CODEX, CURSOR, PI)}


def register(dialect: Dialect) -> None:
    """Add a dialect of the caller's own; jobs look adapters up here."""
    DIALECTS[dialect.id] = dialect


def scan_rank(source_id: str) -> int:
    return list(DIALECTS).index(source_id)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
