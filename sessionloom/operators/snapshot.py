"""Versioned content hashes over a transcript, its attachments and its child links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.joins import lookup

SOURCE_HASH_VERSION = 5
FOLD_LIMIT = 10_000
_NUL = bytearray(b"\0")


def transcript_digest(content: Column) -> Column:
    """Hex digest of the bytes alone."""
    return F.sha2(F.concat(F.lit(bytearray(f"source-v{SOURCE_HASH_VERSION}\0".encode())), content), 256)


def attachment_payload(arcname: Column, content_digest: Column) -> Column:
    """One attachment's share of the hash: its name and the digest of its bytes (hex)."""
    return F.concat(arcname.cast("binary"), F.lit(_NUL), F.unhex(content_digest), F.lit(_NUL))


def child_payload(child_id: Column) -> Column:
    return F.concat(child_id.cast("binary"), F.lit(_NUL))


def chain(
    digests: DataFrame, entries: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Replace `digest` by a hash of it and all entries of its key, in order; keys without entries keep theirs.

    `digests` is unique on `keys`; `entries` has keys, order columns and `payload`.
    The bytes of a key are one ordered stream, so they cannot be hashed in parts.
    Ordinary keys are put together as an array. For a key with more entries than
    `fold_limit` the sorted rows flow through the hash one by one, which needs
    memory for one batch however many there are.
    """
    keys, order = list(keys), list(order)
    # Only keys over the limit, which are few, take the other way; the fold keeps the partitioning of its anti join.
    large = entries.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > fold_limit).select(*keys)
    few = (
        entries.join(large, keys, "left_anti")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(*order, F.hex("payload").alias("_hex")))).alias("_all"))
        .select(*keys, F.unhex(F.array_join(F.transform("_all", lambda e: e["_hex"]), "")).alias("_bytes"))
    )
    seeded = digests.withColumn("_seed", F.concat(F.lit(f"{label}\0"), F.col("digest")).cast("binary"))
    short = seeded.join(few, keys, "left").withColumn(
        "_chained", F.when(F.col("_bytes").isNotNull(), F.sha2(F.concat("_seed", "_bytes"), 256))
    )
    many = lookup(entries.join(large, keys, "left_semi"), seeded.select(*keys, "_seed"), keys, spread_by=order, how="inner")
    streamed = _stream_hash(many, keys, order)
    both = short.drop("_bytes", "_seed").join(streamed, keys, "left")
    return both.withColumn("digest", F.coalesce("_streamed", "_chained", "digest")).drop("_streamed", "_chained")


def _stream_hash(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", _streamed string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            done = []
            values = batch[[*keys, "_seed", "payload"]].itertuples(index=False, name=None)
            for *key, seed, payload in values:
                if key != current:
                    if state is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = key, hashlib.sha256(bytes(seed))
                state.update(bytes(payload))
            if done:
                yield pd.DataFrame(done, columns=[*keys, "_streamed"])
        if state is not None:
            yield pd.DataFrame([(*current, state.hexdigest())], columns=[*keys, "_streamed"])

    arranged = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return arranged.select(*keys, "_seed", "payload").mapInPandas(run, schema)


def source_hashes(
    transcripts: DataFrame, attachments: DataFrame, children: DataFrame, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """source_hash per transcript, from transcripts(session, content); see link_hashes.

    The bytes are digested where they are read and never shuffled.
    """
    digests = transcripts.select("session", transcript_digest(F.col("content")).alias("digest"))
    return link_hashes(digests, attachments, children, fold_limit)


def link_hashes(
    digests: DataFrame, attachments: DataFrame | None, children: DataFrame, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """source_hash from digests(session, digest), attachments(session, kind, path,
    arcname, content_digest) with kept files only, and children(session, child_id)."""
    if attachments is not None:
        files = attachments.select(
            "session", "kind", "path", attachment_payload(F.col("arcname"), F.col("content_digest")).alias("payload")
        )
        digests = chain(digests, files, ["session"], ["kind", "path"], "attachments-v1", fold_limit)
    links = children.select("session", "child_id").distinct().withColumn("payload", child_payload(F.col("child_id")))
    linked = chain(digests, links, ["session"], ["child_id"], "subagent-links-v1", fold_limit)
    return linked.select("session", F.col("digest").alias("source_hash"))


def path_signatures(watched: DataFrame, files: DataFrame) -> DataFrame:
    """signatures(session, path, exists, size, modified) of every path that can affect a bundle.

    `watched` has session and path; a path named twice counts once.
    """
    present = files.select("path", "size", "modified", F.lit(True).alias("_there"))
    joined = lookup(watched.select("session", "path").distinct(), present, ["path"], spread_by=["session"])
    return joined.select("session", "path", F.coalesce("_there", F.lit(False)).alias("exists"), "size", "modified")


def watched_paths(sessions: DataFrame, attachments: DataFrame, folders: DataFrame) -> DataFrame:
    """Every path a bundle depends on: the transcript, its attachments, missing, skipped, and folders."""
    own = sessions.select(F.col("path").alias("session"), "path")
    pointed = attachments.select("session", F.coalesce("path", "reference").alias("path"))
    listed = folders.select("session", F.col("folder").alias("path"))
    return own.unionByName(pointed).unionByName(listed).distinct()


def snapshot_digest(signatures: DataFrame) -> DataFrame:
    """One comparable value per session for all its path signatures.

    Two independent sums of row hashes and a count combine on the map side, so a
    session with very many paths is never collected.
    """
    row = [F.col("path"), F.col("exists"), F.col("size"), F.col("modified")]
    first = F.xxhash64(*row).cast("decimal(38,0)")
    second = F.xxhash64(F.lit("again"), *reversed(row)).cast("decimal(38,0)")
    return signatures.groupBy("session").agg(
        F.concat_ws(":", F.count("*"), F.sum(first), F.sum(second)).alias("file_snapshot")
    )
