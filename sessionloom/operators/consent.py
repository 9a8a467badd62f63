"""Which projects may be synchronized. Consent rows have identity and label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed_projects(projects: DataFrame, consent: DataFrame, all_projects: bool = False) -> DataFrame:
    """Identities that were consented to and still exist; all of them under the override."""
    available = projects.select("identity").distinct()
    return available if all_projects else available.intersect(consent.select("identity"))


def sessions_for_projects(sessions: DataFrame, identities: DataFrame) -> DataFrame:
    return sessions.join(identities.select(F.col("identity").alias("project_id")).distinct(), "project_id", "left_semi")


def invalid_requests(requested: DataFrame, removed: DataFrame, projects: DataFrame) -> DataFrame:
    """Requested identities that are not discovered; any row makes the request invalid."""
    return effective_requests(requested, removed).join(projects.select("identity"), "identity", "left_anti")


def effective_requests(requested: DataFrame, removed: DataFrame) -> DataFrame:
    named = F.coalesce("identity", F.lit("")) != ""
    return requested.where(named).select("identity").distinct().join(removed.select("identity"), "identity", "left_anti")


def update_consent(
    requested: DataFrame, removed: DataFrame, saved: DataFrame, projects: DataFrame, all_projects: bool = False
) -> DataFrame:
    """The consent to save: requested projects plus saved ones that cannot be seen just now.

    Under the override the saved choice is frozen; removals always apply.
    """
    remaining = saved.select("identity", "label").join(removed.select("identity"), "identity", "left_anti")
    if all_projects:
        return remaining
    current = effective_requests(requested, removed).join(projects.select("identity", "label"), "identity")
    unseen = remaining.join(projects.select("identity"), "identity", "left_anti")
    return current.unionByName(unseen)


def distinct_consent(saved: DataFrame) -> DataFrame:
    """Saved rows without blanks and repetitions, in order."""
    return saved.where(F.coalesce("identity", F.lit("")) != "").select("identity", "label").distinct().orderBy("identity", "label")


def reported_consent(saved: DataFrame, projects: DataFrame) -> DataFrame:
    """Saved consent, one row per identity, labelled as the project is labelled now where it is visible."""
    named = saved.where(F.coalesce("identity", F.lit("")) != "")
    one = named.groupBy("identity").agg(F.max("label").alias("_saved"))
    return one.join(projects.select("identity", "label"), "identity", "left").select(
        "identity", F.coalesce("label", "_saved").alias("label")
    )
