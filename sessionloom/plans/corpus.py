"""Queries over projects, attachments, hashes, status, bundles and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import naming
from sessionloom.operators import attachments as att
from sessionloom.operators import budget, consent, listing, package, preview, projects, snapshot, trajectory
from sessionloom.operators import status as st
from sessionloom.plans import native
from sessionloom.plans.privacy import CHECK_SALT
from sessionloom.plans.tables import shared_folder, table, work_folder
from sessionloom.sources import codex
from sessionloom.sources.files import decode_lines


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


# --- projects -------------------------------------------------------------

def _document_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sessions: the label is their source, some have a directory."""
    docs = table(spark, folder, "documents")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    one = F.concat(F.lit("/srv/"), F.col("source"))
    directory = (
        F.when(number % 4 == 0, F.lit(None).cast("string"))
        .when((number % 4 == 1) & (F.col("doc_id") % 2 == 0), one)
        .when((number % 4 == 2) & (F.col("doc_id") % 3 == 0), F.concat(one, F.lit("/"), _text(F.col("doc_id") % 2)))
        .when(number % 4 == 3, one)
    )
    return docs.select(
        F.when(F.col("doc_id") % 2 == 0, "codex").otherwise("pi").alias("source"), _text("doc_id").alias("id"),
        F.format_string("/d/%d.jsonl", "doc_id").alias("path"), F.lit(None).cast("string").alias("parent"),
        F.col("source").alias("project_label"), directory.alias("project_directory"),
        F.timestamp_seconds(F.col("n_chars") * 60 + F.lit(1_600_000_000)).alias("modified"),
        F.struct(F.col("doc_id").alias("n")).alias("ordinal"), "n_chars",
    )


def project_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = projects.merge_projects(_document_sessions(spark, folder))
    found = projects.projects(merged)
    return found.select("identity", "label", "directory", "session_count", F.unix_timestamp("latest_modified").alias("latest"))


def project_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Events as sessions: a user is a project, an event type a harness."""
    events = table(spark, folder, "events").select(
        _text("user_id").alias("project_id"), F.col("event_type").alias("source"), F.col("ts").alias("modified")
    )
    rolled = projects.harness_rollup(events)
    return rolled.select("project_id", "source", "session_count", F.unix_micros(F.col("latest_modified").cast("timestamp")).alias("latest"))


def repository_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as paths below supplier roots: nearest repository, directory, label and key."""
    part = table(spark, folder, "part")
    words = F.split("p_name", " ")
    base = F.concat(F.lit("/srv/u"), _text(F.col("p_partkey") % 10))
    tail = F.array_join(words, "/")
    shape = F.col("p_partkey") % 5
    path = (
        F.when(shape == 0, F.concat(base, F.lit("/"), tail))
        .when(shape == 1, F.concat(base, F.lit("/deep/"), tail, F.lit("/")))
        .when(shape == 2, F.concat(base, F.lit("/x/.claude/worktrees/"), tail))
        .when(shape == 3, F.concat(F.lit("/h/.codex/worktrees/"), _text("p_size"), F.lit("/"), F.get(words, F.lit(0)), F.lit("/y")))
        .otherwise(F.concat(F.lit("/other/"), tail))
    )
    supplier = table(spark, folder, "supplier").select((F.col("s_suppkey") % 10).alias("n")).distinct()
    root = F.concat(F.lit("/srv/u"), _text("n"))
    even = supplier.where(F.col("n") % 2 == 0)
    roots = even.select(root.alias("root"), root.alias("main_root")).unionByName(
        even.select(F.concat(root, F.lit("/deep")).alias("root"), F.concat(root, F.lit("/main")).alias("main_root"))
    )
    remembered = table(spark, folder, "part").where(F.col("p_size") % 2 == 0).select(
        F.concat(F.lit("/h/.codex/worktrees/"), _text("p_size"), F.lit("/red")).alias("worktree"),
        F.lit("/srv/known").alias("identity"), F.lit("known").alias("name"),
    ).distinct()
    paths = part.select("p_partkey", path.alias("path"))
    found = projects.identify(paths, roots, remembered)
    return paths.join(found, "path").select("p_partkey", "path", "directory", "label", "identity", "project_key")


def child_links(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations in groups of three: children of the first of each group."""
    talk = table(spark, folder, "conversations").select("conv_id").distinct()
    merged = talk.select(
        F.lit("p").alias("project_id"), F.lit("pi").alias("source"), _text(F.floor(F.col("conv_id") / 2)).alias("id"),
        F.when(F.col("conv_id") % 3 != 0, _text(F.col("conv_id") - F.col("conv_id") % 3)).alias("parent"),
    )
    counts = projects.child_counts(merged)
    links = projects.child_links(merged).select("project_id", "source", F.col("parent").alias("id"), "child_id")
    return links.join(counts, ["project_id", "source", "id"]).select(
        F.col("id").alias("parent"), "child_id", "children", "distinct_children"
    )


# --- attachments ----------------------------------------------------------

def attach_pointers(spark: SparkSession, folder: str) -> DataFrame:
    """Pointers of both syntaxes put into every turn of the conversations."""
    talk = table(spark, folder, "conversations")
    name = F.concat_ws("-", "conv_id", "turn")
    raw = F.concat(
        F.col("text"), F.lit(' saved to: /p/tool-results/'), name, F.lit('.txt" and </p/tool-results/a/tool-results/b> not (/p/tool-results/n '),
        F.lit("rel/tool-results/c /q/tasks/"), name, F.lit(".output,/q/tasks/"), name, F.lit(".log '/e/terminals/"), name,
        F.lit(".txt' /e/agent-tools/x/"), name,
    )
    lines = talk.select(F.concat(F.lit("/s/"), "conv_id").alias("path"), F.col("turn").alias("seq"), raw.alias("raw"))
    found = att.claude_pointers(lines).unionByName(att.cursor_pointers(lines))
    return found.select(F.substr("session", F.lit(4)).cast("bigint").alias("conv_id"), F.col("place.seq").alias("turn"), "kind", "pointer")


def _item_files(spark: SparkSession, folder: str, session: Column) -> DataFrame:
    items = table(spark, folder, "lineitem")
    path = F.format_string("/f/%010d-%010d-%010d-%d", "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
    return items.select(
        session.alias("session"), F.col("l_returnflag").alias("kind"), path.alias("path"), F.col("l_quantity").cast("bigint").alias("size"),
        F.col("l_extendedprice"),
    ).groupBy("session", "kind", "path").agg(F.max("size").alias("size"))


def attach_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as files of their order, 60 units allowed."""
    files = _item_files(spark, folder, F.col("l_orderkey"))
    kept = budget.within_budget(files, budget=60, checkpoint_dir=shared_folder(spark))
    return kept.select(F.col("session").alias("l_orderkey"), "kind", "path", "size", "kept")


def attach_budget_phased(spark: SparkSession, folder: str) -> DataFrame:
    """The same choice with the limit for folding so low that orders are walked over ranges of rows, and chosen in phases where ranges cut them."""
    files = _item_files(spark, folder, F.col("l_orderkey"))
    kept = budget.within_budget(files, budget=60, fold_limit=2, checkpoint_dir=shared_folder(spark))
    return kept.select(F.col("session").alias("l_orderkey"), "kind", "path", "size", "kept")


def arcname_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as files named by their product, in sessions by brand."""
    part = table(spark, folder, "part")
    files = part.select(
        F.col("p_brand").alias("session"), F.lit("tool-results").alias("kind"), F.col("p_partkey"),
        F.concat(F.format_string("/r/%08d/", "p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".txt")).alias("path"),
    )
    return att.archive_names(files).select("p_partkey", "path", "arcname")


def attachment_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as pointers of their order to part files: found, missing, escaping or over budget."""
    items = table(spark, folder, "lineitem")
    part = F.col("l_partkey")
    pointer = F.concat(F.when(part % 11 == 0, "/else/").otherwise("/r//tool-results/./"), _text("l_partkey"))
    pointers = items.select(
        _text("l_orderkey").alias("session"), pointer.alias("pointer"), F.lit("tool-results").alias("kind"),
        F.struct(F.lit(0).alias("phase"), F.col("l_linenumber").alias("seq"), F.lit(0).alias("at")).alias("place"),
    )
    key = F.col("p_partkey")
    files = table(spark, folder, "part").where(key % 7 != 0).select(
        F.concat(F.lit("/r/tool-results/"), _text("p_partkey")).alias("path"),
        F.when(key % 5 == 0, F.concat(F.lit("/away/"), _text("p_partkey"))).otherwise(
            F.concat(F.lit("/real/"), _text("p_partkey"))
        ).alias("real_path"),
        F.lit(True).alias("is_file"), F.col("p_size").cast("bigint").alias("size"),
    )
    done = att.attach(pointers, files, att.fixed_roots([("/r", "/real")]), budget=60, checkpoint_dir=shared_folder(spark))
    return att.totals(done).select(F.col("session").alias("l_orderkey"), "total_bytes", "files", "missing", "skipped")


# --- hashes ---------------------------------------------------------------

def content_hash(spark: SparkSession, folder: str, fold_limit: int = snapshot.FOLD_LIMIT) -> DataFrame:
    """Documents as transcripts; benchmark-like attachments from pages, children from conversations."""
    docs = table(spark, folder, "documents")
    transcripts = docs.select(F.col("doc_id").alias("session"), F.col("text").cast("binary").alias("content"))
    pages = table(spark, folder, "pages").select(
        (F.col("page_id") * 2).alias("session"), F.lit("tool-results").alias("kind"), "url",
        F.format_string("tool-results/%d.html", "page_id").alias("arcname"), F.sha2("html", 256).alias("content_digest"),
    )
    files = pages.unionByName(pages.withColumn("kind", F.lit("task-outputs")).withColumn("arcname", F.concat(F.lit("t/"), "arcname")))
    talk = table(spark, folder, "conversations")
    children = talk.select((F.col("conv_id") * 3).alias("session"), F.concat(F.lit("k"), _text("turn")).alias("child_id"))
    hashed = snapshot.source_hashes(transcripts, files.withColumnRenamed("url", "path"), children, fold_limit)
    return hashed.select(F.col("session").alias("doc_id"), "source_hash")


def content_hash_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """The same hashes with the limit for folding so low that most entries are streamed."""
    return content_hash(spark, folder, fold_limit=1)


# --- naming, status, bundles ----------------------------------------------

def storage_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys for documents with odd labels and ids, and contributor names from suppliers."""
    docs = table(spark, folder, "documents")
    label = F.get(F.array(F.col("source"), F.lit(""), F.lit("a%b/c\\d"), F.lit("my repo")), (F.col("doc_id") % 4).cast("int"))
    session = F.get(F.array(_text("doc_id"), F.concat(F.lit("a b/"), _text("doc_id")), F.lit(" -x- ")), (F.col("doc_id") % 3).cast("int"))
    who = F.when(F.col("doc_id") % 2 == 0, naming.contributor_name(F.lit(" Jane Doe "))).otherwise(naming.contributor_name(F.lit("  ")))
    return docs.select(
        "doc_id", who.alias("contributor"), naming.bundle_key(who, label, F.lit("codex"), session).alias("key"),
        naming.transcript_id(F.lit("codex"), session).alias("transcript_id"),
    )


def _status_refs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    refs = docs.select(
        F.lit("codex").alias("source"), F.concat(F.lit("label:"), "source").alias("project_id"),
        F.when(F.col("doc_id") % 10 == 0, "p").alias("parent"), _text("doc_id").alias("id"),
        F.concat(F.lit("/d/"), _text("doc_id")).alias("path"), F.col("source").alias("project_label"),
        F.lit(None).cast("string").alias("children_digest"), "doc_id", "text",
    )
    return st.references(refs, "me")


def _stored_objects(refs: DataFrame) -> DataFrame:
    """Objects for four of five documents: current, legacy names, older policy, other hash."""
    way = F.col("doc_id") % 5
    own = snapshot.transcript_digest(F.col("text").cast("binary"))
    new_names = F.create_map(
        F.lit("source-hash"), F.when(way == 3, F.lit("x")).otherwise(own), F.lit("source-hash-version"), F.lit("5"),
        F.lit("redaction-version"), F.when(way == 2, "0").otherwise("1"), F.lit("mts-manifest-version"), F.lit("7"),
    )
    old_names = F.create_map(
        F.lit("content-fingerprint"), own, F.lit("fingerprint-version"), F.lit("5"), F.lit("redaction-version"), F.lit("1"),
        F.lit("mts-manifest-version"), F.lit("7"),
    )
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return refs.where(way != 0).select(
        "key", moment.alias("last_modified"), F.when(way == 1, old_names).otherwise(new_names).alias("metadata")
    )


def _hashes(existing: DataFrame) -> DataFrame:
    """Hashes of documents that have an object; a few fail to be read."""
    failed = F.col("doc_id") % 23 == 1
    return existing.select(
        "path", F.when(~failed, snapshot.transcript_digest(F.col("text").cast("binary"))).alias("source_hash"),
        F.when(~failed, F.col("path")).alias("file_snapshot"), F.when(failed, "OSError: gone").alias("error"),
    )


def _statuses(spark: SparkSession, folder: str) -> DataFrame:
    refs = _status_refs(spark, folder)
    objects = _stored_objects(refs)
    return st.classify(refs.drop("text"), objects, _hashes(st.existing_objects(refs, objects)))


def upload_status(spark: SparkSession, folder: str) -> DataFrame:
    return _statuses(spark, folder).select("doc_id", "key", "state", "error")


def status_summary(spark: SparkSession, folder: str) -> DataFrame:
    statuses = _statuses(spark, folder).withColumn("cached", F.col("doc_id") % 4 == 0)
    return st.refresh_summary(statuses)


def state_counts(spark: SparkSession, folder: str) -> DataFrame:
    return st.state_counts(_statuses(spark, folder))


def status_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses of which two thirds come from the cache and half were checked again, in the order they were asked for."""
    statuses = _statuses(spark, folder)
    cached = statuses.where(F.col("doc_id") % 3 != 0).withColumn("state", F.lit("current"))
    by = [F.reverse(F.col("id")), F.col("id")]
    done = st.in_request_order(_status_refs(spark, folder), cached, statuses.where(F.col("doc_id") % 2 == 0), by, work_folder(spark, "order"))
    return done.select("doc_id", "state", "cached", "position")


def project_order(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers' orders as sessions, a customer as a project: projects newest first, then by label."""
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("unresolved:"), _text("o_custkey")).alias("project_id"), F.concat(F.lit("Label-"), _text("o_custkey")).alias("project_label"),
        F.lit(None).cast("string").alias("project_directory"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").cast("timestamp").alias("modified"),
    )
    done = projects.ordered_projects(projects.projects(orders), work_folder(spark, "order"))
    return done.select("label", "session_count", "position")


def _recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Refs with saved records that differ from them in one respect each."""
    way = F.col("doc_id") % 9
    refs = _status_refs(spark, folder).drop("text").withColumn("file_snapshot_now", F.when(way == 4, "moved").otherwise("same"))
    state = F.get(F.array(*[F.lit(s) for s in ("current", "changed", "not_uploaded", "error")]), (F.col("doc_id") % 4).cast("int"))
    saved = refs.where(way != 8).select(
        F.lit("me").alias("contributor"), "source", "path", F.col("id").alias("session"), "parent",
        F.when(way == 1, "other").otherwise(F.col("project_id")).alias("project"), "key", state.alias("state"),
        F.when(way != 2, "h").alias("source_hash"), F.when(way == 3, "1:1:1").alias("children_digest"), F.lit("same").alias("file_snapshot"),
        F.lit(5).alias("source_hash_version"), F.when(way == 5, 0).otherwise(1).alias("redaction_version"),
        F.lit(7).alias("format_version"), F.lit(None).cast("string").alias("error"),
    )
    return st.candidates(st.with_record(refs, saved, "me"))


def state_reuse(spark: SparkSession, folder: str) -> DataFrame:
    return _recorded(spark, folder).select("doc_id", "cached_state", "decision")


def state_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Saved state after a check of half the documents and publication of a third of them."""
    statuses = _statuses(spark, folder)
    everything = st.as_state(statuses.withColumn("state", F.lit("changed")), "me")
    checked = st.as_state(statuses.where(F.col("doc_id") % 2 == 0), "me")
    merged = st.merge_state(everything, checked)
    done = statuses.where(F.col("doc_id") % 3 == 0).withColumn("source_hash", F.lit("new"))
    after = st.record_uploaded(merged, done, "me")
    return after.select(F.col("session").cast("bigint").alias("doc_id"), "state", "source_hash", "source_hash_version", "error")


def selection_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Line items name documents as sessions, repeatedly and sometimes with the wrong parent."""
    refs = _status_refs(spark, folder).drop("text")
    number = F.col("l_partkey")
    picked = table(spark, folder, "lineitem").select(
        F.lit("codex").alias("source"), F.concat(F.lit("label:src"), _text(number % 20)).alias("project"),
        F.when(number % 2 == 0, "p").otherwise("").alias("parent"), _text(number).alias("session"),
    )
    return st.resolve_selection(picked, refs).select("doc_id", "project_id", "parent")


def consent_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Labels decide consent to documents as projects; requests come with removals."""
    docs = table(spark, folder, "documents")
    found = docs.where(F.col("doc_id") % 5 != 0).select(_text("doc_id").alias("identity"), F.col("source").alias("label"))
    labels = table(spark, folder, "labels")
    saved = labels.where(F.col("quality") == 1).select(_text("doc_id").alias("identity"), F.lit("saved").alias("label"))
    requested = labels.where((F.col("toxic") == 0) & (F.col("doc_id") % 5 != 0)).select(_text("doc_id").alias("identity"))
    removed = labels.where(F.col("doc_id") % 3 == 0).select(_text("doc_id").alias("identity"))
    sessions = docs.select(_text("doc_id").alias("project_id"), F.col("n_chars"))
    parts = {
        "updated": consent.update_consent(requested, removed, saved, found),
        "frozen": consent.update_consent(requested, removed, saved, found, all_projects=True),
        "reported": consent.reported_consent(saved, found),
        "invalid": consent.invalid_requests(requested.unionByName(saved.select("identity")), removed, found).withColumn("label", F.lit("")),
        "allowed": consent.sessions_for_projects(sessions, consent.allowed_projects(found, saved)).select(
            F.col("project_id").alias("identity"), _text("n_chars").alias("label")
        ),
    }
    result = None
    for name, part in parts.items():
        named = part.select(F.lit(name).alias("part"), "identity", "label")
        result = named if result is None else result.unionByName(named)
    return result


def manifest_json(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts of documents with redacted text: fields of the manifest and metadata."""
    refs = _status_refs(spark, folder)
    sessions = refs.withColumns(
        {"source_hash": snapshot.transcript_digest(F.col("text").cast("binary")), "file_snapshot": F.col("path"),
         "launch_kind": F.when(F.col("doc_id") % 2 == 0, "human")}
    )
    contents = refs.select(F.concat(F.col("path"), F.lit(".JSONL")).alias("path"), F.col("text").cast("binary").alias("content"))
    members = package.redact_members(package.transcript_contents(contents), CHECK_SALT)
    counts = package.redaction_counts(members).withColumn("session", F.regexp_replace("session", r"\.JSONL$", ""))
    nothing = counts.select("session", F.lit(0).cast("bigint").alias("files")).where(F.lit(False))
    made = package.artifacts(sessions.drop("text"), counts, nothing, "me")
    doc = F.try_parse_json("manifest")
    return made.select(
        F.col("id").cast("bigint").alias("doc_id"),
        *[
            F.try_variant_get(doc, path, "string").alias(name)
            for name, path in (
                ("manifest_version", "$.manifest_version"), ("manifest_id", "$.id"), ("format", "$.format"),
                ("source_type", "$.source.type"), ("project_name", "$.collection.name"),
                ("redactions", "$.redaction.count"), ("launch_kind", "$.launch_kind"), ("parent_id", "$.parent_id"),
            )
        ],
        F.size("metadata").alias("metadata_fields"), F.element_at("metadata", F.lit("source-hash")).alias("source_hash"),
    )


def key_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses as object keys, listed at two levels."""
    pages = table(spark, folder, "pages")
    objects = pages.select(
        F.concat(F.lit("top/"), F.regexp_replace("url", "^https?://", ""), F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".zip")).alias("key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 3600).alias("last_modified"),
    )
    flat = objects.select(F.concat(F.lit("top/"), F.regexp_replace(F.substr("key", F.lit(5)), "/", "-")).alias("key"), "last_modified")
    both = listing.list_prefix(objects, "top/").unionByName(listing.list_prefix(flat, "top/")).unionByName(listing.list_prefix(objects, ""))
    return both.select("name", "key", "is_folder", "label")


def preview_page(spark: SparkSession, folder: str) -> DataFrame:
    talk = table(spark, folder, "conversations").withColumn("seq", F.col("turn"))
    long_text = F.concat(F.col("text"), F.lit(" mail jo@example.org "), F.repeat(F.lit("x"), F.lit(1500)))
    shown = preview.page(talk.withColumn("text", long_text), ["conv_id"], CHECK_SALT, offset=1, limit=3)
    return shown.select("conv_id", "position", "role", "text", "redaction_count", "total_messages", "next_offset", "has_more")


def preview_deep(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as the messages of a few long sessions: the page at 5,000 and one past every end, where totals remain."""
    item = table(spark, folder, "lineitem")
    said = F.format_string("order %d of jo@example.org", "l_orderkey")
    talk = item.select(
        F.concat("l_returnflag", "l_linestatus").alias("session"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("seq"),
        F.when(F.col("l_linenumber") % 2 == 1, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    index = preview.rank_index(talk, ["session"])
    pages = [preview.deep_page(talk, ["session"], CHECK_SALT, offset, 100, index=index).withColumn("asked", F.lit(offset)) for offset in (5000, 1_000_000_000)]
    return pages[0].unionByName(pages[1])


# --- trajectories ---------------------------------------------------------

def origin_join(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt origins of marked conversations joined back onto their steps."""
    talk = table(spark, folder, "conversations")
    marked = native.claude_lines(
        talk,
        {"promptSource": F.when(F.col("turn") % 4 == 0, "typed"), "entrypoint": F.when(F.col("conv_id") % 2 == 0, "cli"),
         "origin": F.when(F.col("conv_id") % 3 == 0, F.struct(F.lit("human").alias("kind")))},
    )
    decoded = decode_lines(marked).withColumnRenamed("conv_id", "session")
    origins = trajectory.prompt_origins(decoded)
    steps = talk.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("step"), F.col("role").alias("source"),
        F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \n "))).alias("message"),
    )
    done = trajectory.annotate_origins(steps, origins)
    return done.select(
        F.col("session").alias("conv_id"), F.col("step").alias("turn"), "source",
        *[F.try_element_at("origin", F.lit(k)).alias(k) for k in ("origin_kind", "prompt_source", "entrypoint")],
    )


def child_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as a tool call with a result that names children in several ways."""
    talk = table(spark, folder, "conversations")
    way = F.col("turn") % 6
    child = F.concat(F.lit("agent-"), _text("conv_id"), F.lit("x"), _text("turn"))
    short = F.concat(_text("conv_id"), F.lit("x"), _text("turn"))
    content = (
        F.when(way == 0, F.concat(F.lit('{"a":[{"agentId":"'), short, F.lit('"}]}')))
        .when(way == 1, F.concat(F.lit("done by "), child, F.lit(".")))
        .when(way == 2, F.concat(F.lit('{"text":"{\\"session_ids\\":[\\"'), child, F.lit('\\"]}"}')))
        .when(way == 3, F.concat(F.lit("not "), short, F.lit("y")))
        .when(way == 4, F.concat(F.lit('{"other":["'), child, F.lit('"]}')))
        .otherwise(F.lit("nothing"))
    )
    base = talk.select(_text("conv_id").alias("session"), F.col("turn").alias("step"), F.lit("c").alias("call_id"), "conv_id", "turn", content.alias("content"))
    calls = base.select("session", "step", "call_id", F.lit("claude_code").alias("source"),
                        F.when(F.col("conv_id") % 5 == 0, "Bash").otherwise("Task").alias("function_name"))
    results = base.select("session", "step", "call_id", "content", F.lit(None).cast("string").alias("extra"))
    children = talk.select(_text("conv_id").alias("session"), F.lit("claude_code").alias("source"), child.alias("child_id"))
    return trajectory.child_references(calls, results, children).select(
        F.col("session").cast("bigint").alias("conv_id"), F.col("step").alias("turn"), "trajectory_id", "session_id", "trajectory_path"
    )


def mention_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions in whole texts: the references found, and whether under 2 % of the other tokens left their rows."""
    talk = table(spark, folder, "conversations")
    session = (F.col("conv_id") % 50).alias("session")
    child = F.concat(F.lit("agent-"), _text("conv_id"), F.when(F.col("turn") % 9 == 4, "/").otherwise("x"), _text("turn"))
    said = F.concat("text", F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" by "), child, F.lit("."))).otherwise(""))
    base = talk.select(
        session, F.struct("conv_id", "turn").alias("step"), F.lit("c").alias("call_id"), said.alias("content"),
        F.lit(None).cast("string").alias("extra"), child.alias("child_id"), F.lit("claude_code").alias("source"), F.lit("Task").alias("function_name"),
    )
    found = trajectory.child_references(base, base.select("session", "step", "call_id", "content", "extra"), base)
    references = found.select(F.lit("reference").alias("part"), "session", "step.conv_id", "step.turn", "session_id")

    aliases = trajectory.child_aliases(base)
    screened = trajectory.screen_results(trajectory.read_results(base), aliases)
    sent = trajectory.named_children(screened).join(aliases.select("session", F.col("alias").alias("identifier")), ["session", "identifier"], "left_anti")
    words = F.size(F.array_distinct(F.split("content", "[^A-Za-z0-9_-]+")))
    counts = sent.select(F.lit(1).cast("bigint").alias("sent"), F.lit(0).alias("tokens")).unionByName(
        base.select(F.lit(0).cast("bigint").alias("sent"), words.alias("tokens"))
    ).agg(F.sum("sent").alias("sent"), F.sum("tokens").alias("tokens"))
    verdict = F.when(F.col("sent") * 50 <= F.coalesce("tokens", F.lit(0)), "few").otherwise("many")
    none = F.lit(None).cast("bigint")
    return references.unionByName(counts.select(
        F.lit("filter").alias("part"), none.alias("session"), none.alias("conv_id"), none.alias("turn"), verdict.alias("session_id")
    ))


def child_ids_deep(spark: SparkSession, folder: str) -> DataFrame:
    """Child ids below up to eleven objects and lists, and mentions that only string values may make."""
    talk = table(spark, folder, "conversations")
    depth = (F.col("turn") % 12).cast("int")
    child = F.concat(F.lit("child"), _text("conv_id"), F.lit("-"), _text("turn"))
    named = F.concat(F.repeat(F.lit('{"a":[['), depth), F.lit('{"agentId":[[["'), child, F.lit('"]]]}'), F.repeat(F.lit("]]}"), depth))
    extra = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"t":"line\\n'), child, F.lit(' done"}')))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit('{"'), child, F.lit('":true}')))
        .otherwise(F.lit(None).cast("string"))
    )
    base = talk.select(_text("conv_id").alias("session"), F.col("turn").alias("step"), F.lit("c").alias("call_id"), "turn", named.alias("named"), extra.alias("extra"), child.alias("child_id"))
    content = F.when(F.col("turn") % 2 == 0, F.col("named")).otherwise(F.lit("nothing"))
    calls = base.select("session", "step", "call_id", F.lit("claude_code").alias("source"), F.lit("Task").alias("function_name"))
    results = base.select("session", "step", "call_id", content.alias("content"), "extra")
    children = base.select("session", F.lit("claude_code").alias("source"), "child_id")
    return trajectory.child_references(calls, results, children).select(
        F.col("session").cast("bigint").alias("conv_id"), F.col("step").alias("turn"), "session_id"
    )


def codex_cwd_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Working directories below up to eleven objects; one in a shallower object behind it does not come first."""
    talk = table(spark, folder, "conversations")
    depth = (F.col("turn") % 12).cast("int")
    place = F.concat(F.lit("/w/"), _text("conv_id"), F.lit("/"), _text("turn"))
    line = F.concat(
        F.lit('{"payload":'), F.repeat(F.lit('{"session":'), depth), F.lit('{"cwd":"'), place, F.lit('"}'), F.repeat(F.lit("}"), depth),
        F.lit(',"meta":{"cwd":"/later"}}'),
    )
    decoded = decode_lines(talk.select("conv_id", "turn", line.alias("raw")))
    return decoded.select("conv_id", "turn", codex.find_cwd(F.col("v"), F.col("raw")).alias("cwd"))


QUERIES = {
    f.__name__: f
    for f in (
        child_ids_deep, codex_cwd_depth, attach_budget_phased, content_hash_streamed,
        project_merge, project_rollup, repository_roots, child_links, attach_pointers, attach_budget, arcname_collisions,
        attachment_outcomes, content_hash, storage_keys, upload_status, status_summary, state_counts, state_reuse,
        state_merge, selection_resolve, consent_filter, manifest_json, key_listing, preview_page, preview_deep, origin_join, child_refs,
        mention_filter, status_in_order, project_order,
    )
}
