"""Bundles: redacted members, manifest, metadata and the row describing each bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.identity import redact_identity, redact_text
from sessionloom.functions.naming import native_member, transcript_id
from sessionloom.functions.secrets import REDACTION_VERSION
from sessionloom.functions.text import let
from sessionloom.operators import status as st
from sessionloom.operators.snapshot import SOURCE_HASH_VERSION
from sessionloom.sources.files import lossy_text
from sessionloom.sources.registry import DIALECTS

MANIFEST_MEMBER = "manifest.json"
# Names the redaction rules in the manifest; callers may keep a name already in use.
POLICY = "sessionloom"
UNAVAILABLE = "Not published: the session is gone since it was chosen"
MOVED = "Not published: the session has other bytes or files than those checked"
UNANSWERED = "Not published: the upload gave no result"


def source_formats() -> Column:
    return F.create_map(*[F.lit(x) for d in DIALECTS.values() for x in (d.id, d.source_format)])


def split_candidates(candidates: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work, errors): candidates that are still there, and rows for those that are not."""
    identity = ["source", "project_id", "_parent", "id"]
    keyed = sessions.withColumn("_parent", F.coalesce("parent", F.lit("")))
    wanted = candidates.select(
        "source", F.col("project").alias("project_id"), F.coalesce("parent", F.lit("")).alias("_parent"),
        F.col("session").alias("id"), F.struct("state", "source_hash", "file_snapshot").alias("expected"),
    )
    work = keyed.join(wanted, identity).drop("_parent")
    lost = wanted.join(keyed.select(*identity), identity, "left_anti")
    errors = lost.select("source", F.col("id").alias("session"), F.lit(UNAVAILABLE).alias("error"))
    return work, errors


def still_as_hashed() -> Column:
    """A candidate hashed before must still have that hash and those files."""
    before = F.col("expected.state") == "changed"
    return (
        ~before
        | F.col("expected.source_hash").isNull()
        | (
            st.same(F.col("expected.source_hash"), F.col("source_hash"))
            & st.same(F.col("expected.file_snapshot"), F.col("file_snapshot"))
        )
    )


def redact_members(
    contents: DataFrame, salt: bytes, usernames: Sequence[str] = (), stoplist: Sequence[str] = ()
) -> DataFrame:
    """members(session, member_name, text, redactions, …) from contents(session, member_name, content, …).

    Transcripts and attachments are redacted in the row they are read in, decoded once.
    """
    others = [c for c in contents.columns if c != "content"]
    redacted = let(lossy_text(F.col("content")), lambda text: redact_text(text, salt, usernames, stoplist))
    done = contents.select(*others, redacted.alias("r"))
    return done.select(
        *others, F.col("r.text").alias("text"), (F.col("r.secrets") + F.col("r.identity")).alias("redactions")
    )


def transcript_contents(transcripts: DataFrame) -> DataFrame:
    others = [c for c in transcripts.columns if c not in ("path", "content")]
    return transcripts.select(F.col("path").alias("session"), native_member(F.col("path")).alias("member_name"), "content", *others)


def attachment_contents(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of kept attachments; one file can belong to several sessions."""
    kept = attachments.where(F.col("outcome") == "file").select("session", "path", F.col("arcname").alias("member_name"))
    return kept.join(files.select("path", "content"), "path").drop("path")


def redaction_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("session").agg(F.sum("redactions").alias("member_redactions"))


def manifest(contributor: Column, policy: str = POLICY) -> Column:
    """The manifest document; the parent id appears for children only."""
    return F.to_json(
        F.struct(
            F.lit(st.MANIFEST_VERSION).alias("manifest_version"),
            F.col("transcript_id").alias("id"),
            F.col("format"),
            F.struct(F.col("source").alias("type"), F.col("id").alias("id")).alias("source"),
            F.struct(
                F.lit("project").alias("type"), contributor.alias("contributor"), F.col("project_name").alias("name")
            ).alias("collection"),
            F.struct(
                F.lit(f"{policy}/{REDACTION_VERSION}").alias("policy"), F.col("redactions").alias("count")
            ).alias("redaction"),
            F.col("launch_kind"),
            F.col("parent_transcript_id").alias("parent_id"),
        )
    )


def object_metadata() -> Column:
    """String metadata stored beside a bundle, from the columns of an artifact."""
    pairs = {
        st.MANIFEST_VERSION_NAME: F.lit(str(st.MANIFEST_VERSION)),
        st.TRANSCRIPT_ID_NAME: F.col("transcript_id"),
        st.SOURCE_NAME: F.col("source"),
        st.HASH_NAMES[0]: F.col("source_hash"),
        st.HASH_VERSION_NAMES[0]: F.lit(str(SOURCE_HASH_VERSION)),
        st.REDACTION_VERSION_NAME: F.lit(str(REDACTION_VERSION)),
        st.LAUNCH_KIND_NAME: F.coalesce("launch_kind", F.lit("unknown")),
        st.PARENT_ID_NAME: F.col("parent_transcript_id"),
    }
    filled = F.create_map(*[x for name, value in pairs.items() for x in (F.lit(name), value)])
    return F.map_filter(filled, lambda _k, v: v.isNotNull())


def artifacts(
    sessions: DataFrame,
    counts: DataFrame,
    attachment_totals: DataFrame,
    contributor: str,
    usernames: Sequence[str] = (),
    stoplist: Sequence[str] = (),
    policy: str = POLICY,
) -> DataFrame:
    """One row per bundle.

    `sessions` has the session columns plus key, source_hash, file_snapshot,
    children_digest and launch_kind. The project label is redacted like any text.
    """
    label = redact_identity(F.col("project_label"), usernames, stoplist)
    joined = (
        sessions.join(counts.withColumnRenamed("session", "path"), "path", "left")
        .join(attachment_totals.select(F.col("session").alias("path"), F.col("files").alias("attachment_count")), "path", "left")
        .withColumn("_label", label)
    )
    described = joined.select(
        "source", "project_id", "id", F.nullif("parent", F.lit("")).alias("parent"),
        transcript_id(F.col("source"), F.col("id")).alias("transcript_id"),
        transcript_id(F.col("source"), F.nullif(F.col("parent"), F.lit(""))).alias("parent_transcript_id"),
        "path", "key", "source_hash", "file_snapshot", "children_digest",
        F.coalesce("attachment_count", F.lit(0)).alias("attachment_count"),
        (F.coalesce("member_redactions", F.lit(0)) + F.col("_label.n")).alias("redactions"),
        F.col("_label.text").alias("project_name"),
        F.try_element_at(source_formats(), F.col("source")).alias("format"),
        F.coalesce("launch_kind", F.lit("unknown")).alias("launch_kind"),
    )
    return described.withColumns({"manifest": manifest(F.lit(contributor), policy), "metadata": object_metadata()})


def bundle_members(described: DataFrame, members: DataFrame, dropped: DataFrame, batch_id: int) -> DataFrame:
    """bundle_members(key, member_name, content, batch_id): everything published for each bundle.

    `members` are those of all candidates, with the key of their bundle; `dropped` names the sessions that are not
    published. These are few, so the texts of the others are copied where they lie and not dealt by session.
    """
    published = members.join(dropped.select("session"), "session", "left_anti")
    texts = published.select("key", "member_name", F.col("text").alias("content"))
    manifests = described.select("key", F.lit(MANIFEST_MEMBER).alias("member_name"), F.col("manifest").alias("content"))
    return texts.unionByName(manifests).withColumn("batch_id", F.lit(batch_id).cast("bigint"))


def upload_outcomes(artifacts: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uploaded artifacts, errors) from outcomes(path, error): NULL says that the bundle has arrived.

    A bundle counts as uploaded if it has an outcome and none of its outcomes is an error. One without any is an error
    as well: it is not known to have arrived. Outcomes of other paths say nothing.
    """
    judged = outcomes.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("error").alias("_error"))
    uploaded = artifacts.join(judged.where(F.col("_error").isNull()), "path", "left_semi")
    refused = artifacts.join(judged.withColumn("_answered", F.lit(True)), "path", "left").where(
        F.col("_error").isNotNull() | F.col("_answered").isNull()
    )
    errors = refused.select("source", F.col("id").alias("session"), F.coalesce("_error", F.lit(UNANSWERED)).alias("error"))
    return uploaded, errors


def upload_results(described: DataFrame, sizes: DataFrame) -> DataFrame:
    """The result row per published bundle."""
    return described.join(sizes, "key", "left").select(
        "source", F.col("project_id").alias("project"), F.col("id").alias("session"), "parent", "bundle_bytes",
        "redactions", "attachment_count", F.col("key").alias("object_key"), F.lit(1).alias("transcript_count"),
    )


def bundle_sizes(described: DataFrame, members: DataFrame) -> DataFrame:
    """(key, bundle_bytes) from members(key, octets) and the manifests; no text is read for it."""
    manifests = described.select("key", F.octet_length("manifest").alias("octets"))
    return members.select("key", "octets").unionByName(manifests).groupBy("key").agg(F.sum("octets").alias("bundle_bytes"))
