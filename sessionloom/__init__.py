"""A transcript-corpus engine on Spark: DataFrame-to-DataFrame jobs over agent session files."""

from sessionloom.session import configure, local_session

__all__ = ["configure", "local_session"]
