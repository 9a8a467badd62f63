"""Which project a session belongs to, its children, and rollups per project."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.text import path_name
from sessionloom.operators.joins import lookup
from sessionloom.operators.order import numbered
from sessionloom.sources.registry import DIALECTS

UNKNOWN_PROJECT = "(unknown project)"
# Where agents keep temporary checkouts.
WORKTREE_MARKERS = ("/.claude/worktrees/", "/.agents/worktrees/")
_CODEX_WORKTREE = r"^(.*?/\.?codex/worktrees/[^/]+/([^/]+))(?:/|$)"
_CODEX_WORKTREE_INSIDE = r"/\.?codex/worktrees/[^/]+/"
_ENCODED_WORKTREE = r"^(?:(.*)-)?\.?codex-worktrees-([^-]+)-(.+)$"
# Saved editor state that lists project folders.
APP_STATE_KEYS = ("glass.localAgentProjects.v1", "glass.cloudAgentProjects.v1")


def normalize_path(path: Column) -> Column:
    return F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def worktree_root(path: Column) -> Column:
    return F.nullif(F.regexp_extract(normalize_path(path), _CODEX_WORKTREE, 1), F.lit(""))


def canonical_directory(path: Column, repository: Column) -> Column:
    """The project's main directory, or NULL where it cannot be told.

    `repository` is the main root of the nearest enclosing repository, or NULL.
    """
    plain = normalize_path(path)
    cut = F.when(plain == "", F.lit(None).cast("string"))
    for marker in WORKTREE_MARKERS:
        cut = cut.when(plain.contains(marker), F.split_part(plain, F.lit(marker), F.lit(1)))
    return (
        cut.when(~plain.startswith("/"), F.lit(None).cast("string"))
        .when(repository.isNotNull(), repository)
        .when(plain.rlike(_CODEX_WORKTREE_INSIDE), F.lit(None).cast("string"))
        .otherwise(plain)
    )


def project_name(path: Column, directory: Column) -> Column:
    """The label: last part of the directory, or of the path where there is none."""
    named_worktree = F.nullif(F.regexp_extract(normalize_path(path), _CODEX_WORKTREE, 2), F.lit(""))
    last = F.when(
        directory.isNotNull(), F.nullif(path_name(directory), F.lit(""))
    ).otherwise(F.coalesce(named_worktree, F.nullif(path_name(normalize_path(path)), F.lit(""))))
    return F.coalesce(last, F.lit("_root"))


def project_key(identity: Column, name: Column) -> Column:
    return F.concat(F.lit("_project-"), name, F.lit("-"), F.left(F.sha2(identity, 256), F.lit(12)))


def nearest_repository(paths: DataFrame, repo_roots: DataFrame) -> DataFrame:
    """(path, repository) for each distinct path: the closest ancestor that is a repository root.

    Ancestors become rows, so this is an equi join instead of a prefix comparison
    of every path with every root.
    """
    parts = F.split(normalize_path(F.col("path")), "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    exploded = paths.select("path").distinct().select(
        "path", F.explode(F.transform(ancestors, lambda a: F.when(a == "", "/").otherwise(a))).alias("root")
    )
    # Every absolute path has "/" above it: the same few ancestors recur, so the join is salted.
    hit = lookup(exploded, repo_roots.select("root", "main_root").distinct(), ["root"], spread_by=["path"], how="inner")
    return hit.groupBy("path").agg(F.max_by("main_root", F.length("root")).alias("repository"))


def identify(paths: DataFrame, repo_roots: DataFrame, remembered: DataFrame) -> DataFrame:
    """Per distinct path: directory, label, identity and project key.

    A deleted worktree keeps the identity remembered for it; an unknown one gets
    a `stale:` identity. Rows with `worktree` and a directory are what to remember.
    """
    distinct = paths.select("path").distinct()
    rooted = distinct.join(nearest_repository(distinct, repo_roots), "path", "left")
    path, repository = F.col("path"), F.col("repository")
    live = rooted.select(
        "path",
        canonical_directory(path, repository).alias("directory"),
        worktree_root(path).alias("worktree"),
    )
    memory = remembered.select(
        "worktree", F.col("identity").alias("known_identity"), F.col("name").alias("known_name")
    )
    joined = lookup(live, memory, ["worktree"], spread_by=["path"])
    stale = F.concat(F.lit("stale:"), F.coalesce("worktree", normalize_path(path)))
    is_live = F.col("directory").isNotNull()
    named = joined.select(
        "path", "directory", "worktree",
        F.when(is_live, F.col("directory")).otherwise(F.coalesce("known_identity", stale)).alias("identity"),
        F.when(is_live, project_name(path, F.col("directory")))
        .otherwise(F.coalesce("known_name", project_name(path, F.col("directory"))))
        .alias("label"),
    )
    return named.withColumn("project_key", project_key(F.col("identity"), F.col("label")))


def remember(identified: DataFrame) -> DataFrame:
    """(worktree, identity, name) to keep for the time after the worktree is deleted."""
    live = identified.where(F.col("worktree").isNotNull() & F.col("directory").isNotNull())
    return live.groupBy("worktree").agg(
        F.max_by("identity", "path").alias("identity"), F.max_by("label", "path").alias("name")
    )


def decode_dashes(folder: Column) -> Column:
    """A dash-encoded folder of the first dialect as a path."""
    return F.when(folder == "", folder).otherwise(
        F.concat(F.lit("/"), F.replace(F.regexp_replace(folder, "^-", ""), F.lit("-"), F.lit("/")))
    )


def decode_editor_folder(folder: Column) -> Column:
    """A dash-encoded folder of the editor dialect; synthetic names stay readable."""
    def plain(name: Column) -> Column:
        trimmed = F.btrim(F.replace(name, F.lit("\\"), F.lit("-")), F.lit("-"))
        return (
            F.when(name == "", F.lit(UNKNOWN_PROJECT))
            .when((name == "empty-window") | name.rlike(r"^\p{Nd}+$"), name)
            .otherwise(F.concat(F.lit("/"), F.replace(trimmed, F.lit("-"), F.lit("/"))))
        )

    prefix = F.regexp_extract(folder, _ENCODED_WORKTREE, 1)
    worktree = F.regexp_extract(folder, _ENCODED_WORKTREE, 2)
    repository = F.regexp_extract(folder, _ENCODED_WORKTREE, 3)
    before = F.when(prefix == "", F.lit("")).otherwise(F.rtrim(plain(prefix), F.lit("/")))
    rebuilt = F.concat(before, F.lit("/.codex/worktrees/"), worktree, F.lit("/"), repository)
    return F.when(worktree != "", rebuilt).otherwise(plain(folder))


def encode_path(path: Column) -> Column:
    """A path the way the editor names its project folder."""
    trimmed = F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.replace(trimmed, F.lit("/"), F.lit("-"))


def walk_paths(value: str) -> list[str]:
    """Absolute paths in saved editor state: an object's fsPath, its path, then what is in it, in order."""
    try:
        waiting = [json.loads(value)]
    except (ValueError, RecursionError):
        return []
    found = []
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            named = [node.get(name) for name in ("fsPath", "path")]
            found.extend(x for x in named if isinstance(x, str) and x[:1] in ("/", "\\"))
            waiting.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            waiting.extend(reversed(node))
    return found


def path_dictionary(app_state: DataFrame) -> DataFrame:
    """(folder, path) from saved editor state: every path string at any depth, the first met per folder.

    The state is a handful of values per editor; each is walked as a whole."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def walked(values: pa.Array) -> pa.Array:
        return pa.array([walk_paths(x or "") for x in values.to_pylist()], pa.list_(pa.string()))

    found = (
        app_state.where(F.col("key").isin(*APP_STATE_KEYS))
        .select("key", F.posexplode(walked(F.col("value").cast("string"))).alias("at", "path"))
        .withColumn("folder", encode_path(F.col("path")))
    )
    # The first saved key in name order that is listed first wins.
    rank = F.when(F.col("key") == APP_STATE_KEYS[0], 0).otherwise(1)
    return found.groupBy("folder").agg(F.min_by("path", F.struct(rank, F.col("at"))).alias("path"))


def _dash_parts(text: Column) -> Column:
    return F.filter(F.split(text, "-"), lambda part: part != "")


def recover_folders(folders: DataFrame, directories: DataFrame) -> DataFrame:
    """(folder, recovered): the existing directory a dash-encoded name stands for.

    Where several fit, the longest first component wins, then the next.
    """
    by_code = (
        directories.where(~F.col("path").rlike(r"(^|/)-|--|-(/|$)") & (F.col("path") != "/"))
        .withColumn("code", F.array_join(_dash_parts(F.replace("path", F.lit("/"), F.lit("-"))), "-"))
        .groupBy("code")
        .agg(
            F.max_by("path", F.transform(F.split(F.substring("path", 2, 1 << 30), "/"), lambda p: F.size(_dash_parts(p)))).alias(
                "recovered"
            )
        )
    )
    coded = folders.select("folder").where(F.col("folder").isNotNull()).distinct().withColumn(
        "code", F.array_join(_dash_parts(F.replace("folder", F.lit("\\"), F.lit("-"))), "-")
    )
    return coded.join(by_code, "code").select("folder", "recovered")


def container_cwd(sessions: DataFrame) -> DataFrame:
    """(folder, container): the first known working directory of a project folder."""
    known = sessions.where((F.col("source") == "claude_code") & F.col("cwd").isNotNull())
    return known.groupBy("source", "folder").agg(F.min_by("cwd", "ordinal").alias("container"))


def assign_projects(
    sessions: DataFrame,
    repo_roots: DataFrame,
    directories: DataFrame,
    dictionary: DataFrame,
    remembered: DataFrame,
) -> DataFrame:
    """Adds project_label and project_directory to every session."""
    lent = lookup(sessions, container_cwd(sessions), ["source", "folder"], spread_by=["path"])
    recovered = recover_folders(sessions, directories)
    with_folder = lookup(lent, recovered, ["folder"], spread_by=["path"])
    listed = lookup(
        with_folder, dictionary.select("folder", F.col("path").alias("listed")), ["folder"], spread_by=["path"]
    )
    first = F.col("source") == "claude_code"
    editor = F.col("source") == "cursor"
    known = (
        F.when(first, F.coalesce("cwd", "container", "recovered"))
        .when(editor, F.coalesce("listed", "recovered"))
        .otherwise(F.nullif(F.col("cwd"), F.lit("")))
    )
    guessed = F.when(first, decode_dashes(F.col("folder"))).when(editor, decode_editor_folder(F.col("folder")))
    observed = (
        listed.withColumn("_known", known)
        .withColumn("_observed", F.coalesce(F.col("_known"), guessed))
        .drop("container", "recovered", "listed")
    )
    identified = identify(
        observed.where(F.col("_observed").isNotNull()).select(F.col("_observed").alias("path")), repo_roots, remembered
    ).select(F.col("path").alias("_observed"), F.col("directory").alias("_directory"), F.col("label").alias("_label"))
    joined = lookup(observed, identified, ["_observed"], spread_by=["path"])
    return joined.select(
        *sessions.columns,
        F.coalesce("_label", F.lit(UNKNOWN_PROJECT)).alias("project_label"),
        F.when(F.col("_known").isNotNull(), F.col("_directory")).alias("project_directory"),
    )


def fill_directories(sessions: DataFrame) -> DataFrame:
    """A session without a directory takes the only one its label has, if there is exactly one."""
    single = (
        sessions.where(F.nullif("project_directory", F.lit("")).isNotNull())
        .groupBy("project_label")
        .agg(F.min("project_directory").alias("_only"), F.max("project_directory").alias("_last"))
        .where(F.col("_only") == F.col("_last"))
        .drop("_last")
    )
    joined = lookup(sessions, single, ["project_label"], spread_by=["path"])
    return joined.withColumn("project_directory", F.coalesce("project_directory", "_only")).drop("_only")


def merge_projects(sessions: DataFrame) -> DataFrame:
    """Adds project_id: the directory where it is known, otherwise the label."""
    directory = F.nullif(F.col("project_directory"), F.lit(""))
    identity = F.when(directory.isNotNull(), F.concat(F.lit("directory:"), directory)).otherwise(
        F.concat(F.lit("unresolved:"), F.col("project_label"))
    )
    return fill_directories(sessions).withColumn("project_id", identity)


def projects(merged: DataFrame) -> DataFrame:
    """One row per project, label and directory as first met, newest first."""
    grouped = merged.groupBy("project_id").agg(
        F.min_by(F.struct("project_label", "project_directory"), "ordinal").alias("_first"),
        F.count("*").alias("session_count"),
        F.max("modified").alias("latest_modified"),
    )
    flat = grouped.select(
        F.col("project_id").alias("identity"), F.col("_first.project_label").alias("label"),
        F.col("_first.project_directory").alias("directory"), "session_count", "latest_modified",
    )
    return flat.orderBy(*_project_order())


def _project_order() -> list[Column]:
    return [
        F.coalesce("latest_modified", F.timestamp_seconds(F.lit(0))).desc(), F.lower("label"), F.coalesce("directory", F.lit(""))
    ]


def ordered_projects(listed: DataFrame, folder: str) -> DataFrame:
    """Projects with their `position` in the order of the list; equal ones by identity. `folder`: see `order.numbered`."""
    return numbered(listed, [*_project_order(), F.col("identity")], folder)


def harness_rollup(merged: DataFrame) -> DataFrame:
    """Sessions per project and dialect, newest dialect first within a project."""
    labels = F.create_map(*[F.lit(x) for d in DIALECTS.values() for x in (d.id, d.label)])
    return (
        merged.groupBy("project_id", "source")
        .agg(F.count("*").alias("session_count"), F.max("modified").alias("latest_modified"))
        .withColumn("source_label", F.coalesce(F.try_element_at(labels, F.col("source")), F.col("source")))
        .orderBy("project_id", F.col("latest_modified").desc_nulls_last(), F.lower("source_label"))
    )


def child_links(merged: DataFrame) -> DataFrame:
    """One row per parent and child within a project; duplicates stay.

    Kept as rows: one parent may own a large share of all sessions.
    """
    linked = merged.where(F.coalesce("parent", F.lit("")) != "")
    return linked.select("project_id", "source", "parent", F.col("id").alias("child_id"))


def child_counts(merged: DataFrame) -> DataFrame:
    """Number of children and distinct children per session that has any."""
    per_child = child_links(merged).groupBy("project_id", "source", "parent", "child_id").agg(F.count("*").alias("n"))
    return per_child.groupBy("project_id", "source", F.col("parent").alias("id")).agg(
        F.sum("n").alias("children"), F.count("*").alias("distinct_children")
    )


def current_sessions(merged: DataFrame) -> DataFrame:
    """One session per (source, project, parent, id); the one met last wins."""
    keyed = merged.withColumn("_parent", F.coalesce("parent", F.lit("")))
    others = [c for c in keyed.columns if c not in ("source", "project_id", "_parent", "id")]
    last = keyed.groupBy("source", "project_id", "_parent", "id").agg(F.max_by(F.struct(*others), "ordinal").alias("_row"))
    return last.select("source", "project_id", "id", *[F.col(f"_row.{c}").alias(c) for c in others]).select(*merged.columns)

