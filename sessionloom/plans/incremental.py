"""The incremental run over documents as transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.plans.privacy import CHECK_SALT
from sessionloom.plans.tables import table, work_folder
from sessionloom.sources.store import current_bundles
from sessionloom.streaming import sync


def _path(doc: DataFrame) -> DataFrame:
    return doc.withColumn("path", F.format_string("/d/%d.jsonl", "doc_id"))


def _described(docs: DataFrame) -> DataFrame:
    """What a session row needs of a document; the text is cut where it is read, not behind a join that would shuffle it."""
    return docs.select("path", "doc_id", "source", F.left("text", F.lit(20)).alias("first_message"))


def incremental_sync(spark: SparkSession, folder: str) -> DataFrame:
    """First half of the documents, then the other half plus changes: what is published when, and under which hash."""
    docs = _path(table(spark, folder, "documents"))
    base = work_folder(spark, "sync")
    store, changes = f"{base}/store", f"{base}/changes"

    def inventory(rows: DataFrame, round_no: int) -> DataFrame:
        return rows.select(
            "path", (F.col("n_chars") + round_no).alias("size"),
            F.timestamp_seconds(F.lit(1_700_000_000 + round_no)).alias("modified"),
        )

    def describe(changed: DataFrame) -> DataFrame:
        rows = _described(docs).join(changed, "path")
        return rows.select(
            F.lit("codex").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"),
            F.lit(False).alias("is_subagent"), "path", F.col("size").alias("size_bytes"), "modified", F.lit(1).alias("message_count"),
            "first_message", F.col("source").alias("project_label"),
            F.lit(None).cast("string").alias("project_directory"), F.lit("human").alias("own_kind"),
        )

    def plan(second: bool) -> sync.SyncPlan:
        edited = (F.col("doc_id") % 4 == 0) & F.lit(second)
        text = F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text"))

        def contents(paths: DataFrame) -> DataFrame:
            return docs.join(paths, "path", "left_semi").select("path", text.cast("binary").alias("content"))

        return sync.SyncPlan(store=store, contributor="me", describe=describe, contents=contents, salt=CHECK_SALT)

    even, quarter = F.col("doc_id") % 2 == 0, F.col("doc_id") % 4 == 0
    inventory(docs.where(even), 0).write.mode("append").parquet(changes)
    sync.start(spark, plan(False), changes, f"{base}/progress").awaitTermination()
    # The unchanged even ones are seen again with the same size and time.
    second = inventory(docs.where(~even | quarter), 1).unionByName(inventory(docs.where(even & ~quarter), 0))
    second.write.mode("append").parquet(changes)
    sync.start(spark, plan(True), changes, f"{base}/progress").awaitTermination()

    tables = sync.Tables(spark, store)
    published = current_bundles(tables.members.read()).where(F.col("member_name") == "transcript.jsonl")
    state = tables.state.read()
    joined = state.join(published.select("key", "batch_id", F.length("content").alias("characters")), "key", "left")
    return joined.select(F.col("session").cast("bigint").alias("doc_id"), "state", "source_hash", "batch_id", "characters", "error")


def sync_repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Two files for each id, four batches of which the second and the last are idle: what each file's state is, what its key
    holds, and how many rows the idle batches have written."""
    docs = _path(table(spark, folder, "documents"))
    base = work_folder(spark, "repeated")
    store, changes = f"{base}/store", f"{base}/changes"
    edited = F.col("doc_id") % 8 == 1

    def inventory(rows: DataFrame, round_no: int) -> DataFrame:
        later = F.when(edited, F.lit(round_no)).otherwise(0)
        return rows.select("path", (F.col("n_chars") + later).alias("size"), F.timestamp_seconds(1_700_000_000 + later).alias("modified"))

    def describe(changed: DataFrame) -> DataFrame:
        return _described(docs).join(changed, "path").select(
            F.lit("codex").alias("source"), F.floor(F.col("doc_id") / 2).cast("string").alias("id"), F.lit(None).cast("string").alias("parent"),
            F.lit(False).alias("is_subagent"), "path", F.col("size").alias("size_bytes"), "modified", F.lit(1).alias("message_count"),
            "first_message", F.lit("app").alias("project_label"),
            F.lit(None).cast("string").alias("project_directory"), F.lit("human").alias("own_kind"),
        )

    def plan(last: bool) -> sync.SyncPlan:
        text = F.when(edited & F.lit(last), F.concat("text", F.lit("!"))).otherwise(F.col("text"))

        def contents(paths: DataFrame) -> DataFrame:
            return docs.join(paths, "path", "left_semi").select("path", text.cast("binary").alias("content"))

        return sync.SyncPlan(store=store, contributor="me", describe=describe, contents=contents, salt=CHECK_SALT)

    tables, idle = sync.Tables(spark, store), 0
    for step, round_no in enumerate((0, 0, 1, 1)):
        inventory(docs, round_no).write.mode("append").parquet(changes)
        sync.start(spark, plan(round_no == 1), changes, f"{base}/progress").awaitTermination()
        if step in (1, 3):
            idle += tables.state.head().written + tables.objects.head().written

    objects = tables.objects.read().groupBy("key").agg(F.count("*").alias("objects"))
    members = tables.members.read().groupBy("key").agg(F.count("*").alias("members"), F.max("batch_id").alias("batch_id"))
    records = tables.state.read()
    files = records.groupBy("key").agg(F.count("*").alias("records"))
    joined = records.join(objects, "key").join(members, "key").join(files, "key")
    number = F.regexp_extract("path", r"/d/(\d+)\.jsonl", 1).cast("bigint")
    return joined.select(number.alias("doc_id"), "state", "source_hash", "objects", "members", "records", "batch_id", F.lit(idle).cast("bigint").alias("idle_rows"))


def sync_partial_write(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, then a batch in which one in a hundred has changed: states as a full run has them, and the rows that
    each batch wrote to sessions, state and objects."""
    docs = _path(table(spark, folder, "documents"))
    base = work_folder(spark, "partial")
    store, changes = f"{base}/store", f"{base}/changes"
    edited = F.col("doc_id") % 100 == 0

    def inventory(rows: DataFrame, round_no: int) -> DataFrame:
        return rows.select("path", (F.col("n_chars") + round_no).alias("size"), F.timestamp_seconds(F.lit(1_700_000_000 + round_no)).alias("modified"))

    def describe(changed: DataFrame) -> DataFrame:
        return _described(docs).join(changed, "path").select(
            F.lit("codex").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"),
            F.lit(False).alias("is_subagent"), "path", F.col("size").alias("size_bytes"), "modified", F.lit(1).alias("message_count"),
            "first_message", F.col("source").alias("project_label"),
            F.lit(None).cast("string").alias("project_directory"), F.lit("human").alias("own_kind"),
        )

    def plan(second: bool) -> sync.SyncPlan:
        text = F.when(edited & F.lit(second), F.concat("text", F.lit("!"))).otherwise(F.col("text"))

        def contents(paths: DataFrame) -> DataFrame:
            return docs.join(paths, "path", "left_semi").select("path", text.cast("binary").alias("content"))

        return sync.SyncPlan(store=store, contributor="me", describe=describe, contents=contents, salt=CHECK_SALT)

    tables, written = sync.Tables(spark, store), []
    for round_no in (0, 1):
        inventory(docs.where(edited | F.lit(round_no == 0)), round_no).write.mode("append").parquet(changes)
        sync.start(spark, plan(round_no == 1), changes, f"{base}/progress").awaitTermination()
        written.append([t.head().written for t in (tables.sessions, tables.state, tables.objects)])
    counts = [F.lit(n).cast("bigint").alias(f"{name}_{k}") for k, row in enumerate(written) for name, n in zip(("sessions", "state", "objects"), row, strict=True)]
    return tables.state.read().select(F.col("session").cast("bigint").alias("doc_id"), "state", "source_hash", *counts)


def publish_results(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh upload fails, and every fourteenth again when a second batch tries what is left: states, the batch that
    each bundle was uploaded in, its errors, and what the two runs report."""
    docs = _path(table(spark, folder, "documents"))
    base = work_folder(spark, "publish")
    store, changes = f"{base}/store", f"{base}/changes"

    def inventory(rows: DataFrame) -> DataFrame:
        return rows.select("path", F.col("n_chars").cast("bigint").alias("size"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("modified"))

    def describe(changed: DataFrame) -> DataFrame:
        return _described(docs).join(changed, "path").select(
            F.lit("codex").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"),
            F.lit(False).alias("is_subagent"), "path", F.col("size").alias("size_bytes"), "modified", F.lit(1).alias("message_count"),
            "first_message", F.col("source").alias("project_label"),
            F.lit(None).cast("string").alias("project_directory"), F.lit("human").alias("own_kind"),
        )

    def contents(paths: DataFrame) -> DataFrame:
        return docs.join(paths, "path", "left_semi").select("path", F.col("text").cast("binary").alias("content"))

    def publish(artifacts: DataFrame, _members: DataFrame, batch_id: int) -> DataFrame:
        refused = F.col("id").cast("bigint") % (7 * (batch_id + 1)) == 0
        tried = artifacts.select("path", F.when(refused, "full").alias("error"), refused.alias("_refused"))
        # Half of the refusals give no outcome at all.
        return tried.where(~F.col("_refused") | (F.crc32(F.col("path").cast("binary")) % 2 == 0))

    plan = sync.SyncPlan(store=store, contributor="me", describe=describe, contents=contents, publish=publish, salt=CHECK_SALT)
    for rows in (docs, docs.where(F.col("doc_id") % 100 == 1)):
        inventory(rows).write.mode("append").parquet(changes)
        sync.start(spark, plan, changes, f"{base}/progress").awaitTermination()

    tables = sync.Tables(spark, store)
    results, errors = tables.results.read(), tables.errors.read().groupBy("session").agg(F.count("*").alias("failures"))
    held = current_bundles(tables.members.read(), results).groupBy("key").agg(
        F.sum(F.octet_length("content")).cast("bigint").alias("held"), F.max("batch_id").alias("batch_id")
    )
    uploads = results.select(F.col("object_key").alias("key"), "bundle_bytes").join(held, "key").select(
        "key", "batch_id", (F.col("held") == F.col("bundle_bytes")).alias("whole")
    )
    runs = tables.runs.read().groupBy().agg(*[
        F.max(F.when(F.col("batch_id") == b, F.col(c))).alias(f"{c}_{b}") for b in (0, 1) for c in ("status", "sessions_uploaded", "errors")
    ])
    state = tables.state.read().join(uploads, "key", "left").join(errors, "session", "left")
    rows = state.select(
        F.col("session").cast("bigint").alias("doc_id"), "state", "source_hash", "batch_id", "whole", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"), F.lit(1).alias("_k")
    )
    return rows.join(runs.withColumn("_k", F.lit(1)), "_k").drop("_k")


QUERIES = {"publish_results": publish_results, "incremental_sync": incremental_sync, "sync_repeated_ids": sync_repeated_ids, "sync_partial_write": sync_partial_write}
_EMAIL = r"(^|[^A-Za-z0-9._%+\-\\@])([A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24})"
_SECRET = r"""(?i)((?:password|passwd|secret|token|api_key|apikey|access_key)\s*[=:]\s*["''])([^"'']{8,})(["''])"""
ORACLES = {
    "publish_results": """
  WITH n AS (SELECT count(*) FILTER (doc_id % 7 <> 0) AS a, count(*) FILTER (doc_id % 7 = 0) AS b, count(*) FILTER (doc_id % 7 = 0 AND doc_id % 14 <> 0) AS c,
                    count(*) FILTER (doc_id % 14 = 0) AS d FROM documents)
  SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 'not_uploaded' ELSE 'current' END AS state,
    CASE WHEN doc_id % 14 <> 0 THEN sha256(encode('source-v5') || unhex('00') || encode(text)) END AS source_hash,
    CASE WHEN doc_id % 14 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS batch_id,
    CASE WHEN doc_id % 14 <> 0 THEN true END AS whole,
    CASE WHEN doc_id % 14 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS failures,
    CASE WHEN b > 0 THEN 'partial' ELSE 'completed' END AS status_0, a AS sessions_uploaded_0, b AS errors_0,
    CASE WHEN d > 0 THEN 'partial' ELSE 'completed' END AS status_1, c AS sessions_uploaded_1, d AS errors_1 FROM documents, n""",
    "incremental_sync": f"""
  WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END AS t FROM documents)
  SELECT doc_id, 'current' AS state, sha256(encode('source-v5') || unhex('00') || encode(t)) AS source_hash,
    CASE WHEN doc_id % 4 = 2 THEN 0 ELSE 1 END::BIGINT AS batch_id,
    length(regexp_replace(regexp_replace(t, '{_SECRET}', '\\1' || repeat('m', 16) || '\\3', 'g'), '{_EMAIL}', '\\1[EMAIL]', 'g'))::INTEGER AS characters,
    NULL::VARCHAR AS error FROM d""",
    "sync_repeated_ids": """
  WITH d AS (SELECT doc_id, doc_id // 2 AS id, text || CASE WHEN doc_id % 8 = 1 THEN '!' ELSE '' END AS t,
                    '/d/' || doc_id || '.jsonl' AS path FROM documents),
  w AS (SELECT id, max_by(doc_id, path) AS winner, max_by(doc_id % 8 = 1, path) AS again, count(*) AS n FROM d GROUP BY id)
  SELECT doc_id, CASE WHEN doc_id = winner THEN 'current' ELSE 'not_uploaded' END AS state,
    CASE WHEN doc_id = winner THEN sha256(encode('source-v5') || unhex('00') || encode(t)) END AS source_hash, 1::BIGINT AS objects,
    CASE WHEN again THEN 4 ELSE 2 END::BIGINT AS members, n AS records, CASE WHEN again THEN 2 ELSE 0 END::BIGINT AS batch_id, 0::BIGINT AS idle_rows
  FROM d JOIN w ON d.id = w.id""",
    "sync_partial_write": """
  WITH n AS (SELECT count(*) AS everything, count(*) FILTER (doc_id % 100 = 0) AS edited FROM documents)
  SELECT doc_id, 'current' AS state,
    sha256(encode('source-v5') || unhex('00') || encode(text || CASE WHEN doc_id % 100 = 0 THEN '!' ELSE '' END)) AS source_hash,
    everything AS sessions_0, everything AS state_0, everything AS objects_0, edited AS sessions_1, edited AS state_1, edited AS objects_1
  FROM documents, n""",
}
