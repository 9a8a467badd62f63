"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.identity import redact_text
from sessionloom.plans import corpus, corpus_sql, incremental, privacy, reading, scanning

_PARTS = (reading, privacy, corpus, incremental, scanning)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in (reading, privacy, corpus_sql, incremental, scanning) for name, sql in part.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Session summary whose first message is redacted."""
    summary = reading.session_summary(spark, folder)
    return summary.withColumn("first_message", redact_text(F.col("first_message"), bytes(16))["text"])
