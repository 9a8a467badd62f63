"""Files a transcript points at: pointers in the text, checked against a file inventory."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import WHITESPACE_CLASS, let, path_name, path_parent, path_stem, path_suffix
from sessionloom.operators.budget import DEFAULT_BUDGET, FOLD_LIMIT, within_budget, written
from sessionloom.operators.joins import lookup
from sessionloom.session import checkpoint_folder

# What ends a path token, and where spilled output lives.
_DELIMITERS = r"""[ \t\r\n"'\\<>,)\]]"""
TOOL_RESULTS = "/tool-results/"
TASKS = "/tasks/"
TASK_SUFFIX = ".output"
_EDITOR_CHARS = rf"""[^{WHITESPACE_CLASS}"'\\<>,)\]]"""
_EDITOR_LAST = rf"""[^{WHITESPACE_CLASS}"'\\<>,)\]/]"""
EDITOR_POINTER = rf"/{_EDITOR_CHARS}*/(agent-tools|terminals)/{_EDITOR_LAST}+"


def marker_pointers(text: Column, marker: str, suffix: str = "") -> Column:
    """Absolute paths around each occurrence of a literal marker, in text order.

    A pointer starts at its token and ends at the next slash behind the marker. The
    text is cut at delimiters once, so the cost is linear.
    """
    tokens = F.filter(F.split(text, _DELIMITERS), lambda t: t.contains(marker) & t.startswith("/"))

    def of_token(token: Column) -> Column:
        def cut(parts: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda n: F.concat(
                    F.array_join(F.slice(parts, F.lit(1), n), marker),
                    F.lit(marker),
                    F.substring_index(F.get(parts, n), "/", 1),
                ),
            )

        return let(F.split(token, rf"\Q{marker}\E", -1), cut)

    found = F.flatten(F.transform(tokens, of_token))
    if suffix:
        found = F.filter(found, lambda p: p.endswith(suffix))
    return F.when(text.contains(marker), found).otherwise(F.array().cast("array<string>"))


def editor_pointers(text: Column) -> Column:
    likely = text.contains("/agent-tools/") | text.contains("/terminals/")
    found = F.regexp_extract_all(text, F.lit(EDITOR_POINTER), F.lit(0))
    return F.when(likely, found).otherwise(F.array().cast("array<string>"))


def _rows(lines: DataFrame, phase: int, pointers: Column, kind: Column) -> DataFrame:
    exploded = lines.select(
        F.col("path").alias("session"), F.col("seq"), F.posexplode(pointers).alias("at", "pointer")
    )
    return exploded.select(
        "session", "pointer", kind.alias("kind"), F.struct(F.lit(phase).alias("phase"), "seq", "at").alias("place")
    )


def claude_pointers(lines: DataFrame) -> DataFrame:
    """pointers(session, pointer, kind, place) in the order they are followed."""
    results = _rows(lines, 0, marker_pointers(F.col("raw"), TOOL_RESULTS), F.lit("tool-results"))
    tasks = _rows(lines, 1, marker_pointers(F.col("raw"), TASKS, TASK_SUFFIX), F.lit("task-outputs"))
    return results.unionByName(tasks)


def cursor_pointers(lines: DataFrame) -> DataFrame:
    kind = F.element_at(F.split("pointer", "/"), -2)
    return _rows(lines, 0, editor_pointers(F.col("raw")), kind)


def owned_folders(sessions: DataFrame) -> DataFrame:
    """(session, folder): the output folder a top-level session owns outright."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    return sessions.where(~F.col("is_subagent")).select(
        F.col("path").alias("session"), F.concat(stem, F.lit("/tool-results")).alias("folder")
    )


def folder_pointers(folders: DataFrame, files: DataFrame, kind: str, like: DataFrame) -> DataFrame:
    """Every inventory entry directly inside an owned folder, as pointers after all others."""
    entries = files.select(F.col("path").alias("pointer"), path_parent(F.col("path")).alias("folder"))
    inside = lookup(entries, folders.select("folder", "session"), ["folder"], spread_by=["pointer"], how="inner")
    seq_type = like.schema["place"].dataType["seq"].dataType
    place = F.struct(F.lit(2).alias("phase"), F.lit(None).cast(seq_type).alias("seq"), F.lit(0).alias("at"))
    return inside.select("session", "pointer", F.lit(kind).alias("kind"), place.alias("place"))


def tidy_path(path: Column) -> Column:
    """Repeated and trailing slashes and single dots removed."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def resolve_dots(path: Column) -> Column:
    """Parent steps applied, for finding the path in an inventory."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.array_append(done, part)
        )

    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, empty, step), "/"))
    return F.when(path.contains("/.."), folded).otherwise(path)


def inside(path: Column, root: Column) -> Column:
    """Whether a path is the root or below it, by whole parts."""
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def fixed_roots(roots: Sequence[tuple[str, str]]) -> Column:
    """The same owned folders for every session, as (root, real root) in order."""
    return F.array(*[F.struct(F.lit(a).alias("root"), F.lit(b).alias("real_root")) for a, b in roots])


def editor_root() -> Column:
    """The project folder a session lies in, as its only root."""
    project = F.regexp_extract("session", r"^(.*?)/agent-transcripts/", 1)
    return F.array(F.struct(project.alias("root"), project.alias("real_root")))


def resolve_pointers(pointers: DataFrame, files: DataFrame, roots: Column) -> DataFrame:
    """Outcome per pointer: found files once per real file, and pointers whose target is gone.

    `files` has path, real_path, is_file and size. A pointer counts only inside a
    root; the first root that contains it decides, and a file whose real place lies
    outside that root is left out.
    """
    first_seen = pointers.groupBy("session", "pointer", "kind").agg(F.min("place").alias("place"))
    tidy = first_seen.where(F.col("pointer").startswith("/")).withColumn("_tidy", tidy_path(F.col("pointer")))
    claimed = tidy.withColumn("_roots", roots).withColumn(
        "_claim", F.get(F.filter("_roots", lambda r: inside(F.col("_tidy"), r["root"])), F.lit(0))["real_root"]
    )
    owned = claimed.where(F.col("_claim").isNotNull()).drop("_roots").withColumn("_path", resolve_dots(F.col("_tidy")))
    inventory = files.select(F.col("path").alias("_path"), "real_path", "is_file", "size")
    return lookup(owned, inventory, ["_path"], spread_by=["session", "pointer"])


def attach(
    pointers: DataFrame,
    files: DataFrame,
    roots: Column,
    budget: int = DEFAULT_BUDGET,
    fold_limit: int = FOLD_LIMIT,
    checkpoint_dir: str | None = None,
) -> DataFrame:
    """attachments(session, path, reference, arcname, kind, size, outcome) with file, missing and skipped rows.

    What the pointers lead to is written once, and so is what the budget keeps; all outcomes are read from these."""
    work = f"{checkpoint_folder(pointers.sparkSession, checkpoint_dir)}/attach-{uuid.uuid4().hex}"
    resolved = resolve_pointers(pointers, files, roots)
    there = F.col("real_path").isNotNull()
    followed = resolved.where(~there | (F.col("is_file") & inside(F.col("real_path"), F.col("_claim"))))
    led = followed.groupBy("session", F.col("real_path").alias("path"), F.when(~there, F.col("pointer")).alias("gone")).agg(
        F.min_by(F.struct("kind", "pointer", "size"), F.struct("place", "pointer")).alias("_first")
    ).select("session", "path", "gone", F.col("_first.kind").alias("kind"), F.col("_first.pointer").alias("reference"), F.col("_first.size").alias("size"))
    met = written(led, f"{work}/met")
    missing = met.where(F.col("path").isNull()).select("session", F.col("gone").alias("pointer"))
    found = met.where(F.col("path").isNotNull()).drop("gone")
    chosen = written(within_budget(found, budget, fold_limit, checkpoint_dir, stored=True), f"{work}/chosen")
    kept = archive_names(chosen.where("kept").drop("kept"))
    skipped = chosen.where(~F.col("kept")).select(
        "session", "path", "kind", "reference", "size", F.lit(None).cast("string").alias("arcname"), F.lit("skipped").alias("outcome")
    )
    gone = missing.select(
        "session", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("kind"),
        F.col("pointer").alias("reference"), F.lit(None).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("arcname"), F.lit("missing").alias("outcome"),
    )
    return kept.withColumn("outcome", F.lit("file")).unionByName(skipped).unionByName(gone)


def archive_names(files: DataFrame) -> DataFrame:
    """Adds `arcname`: kind/name, with a digest of the path where that name is taken.

    The first file in (kind, path) order keeps the plain name. A plain name that
    equals a digest name given earlier is taken as well.
    """
    name = path_name(F.col("path"))
    digest = F.left(F.sha2(F.col("path").cast("binary"), 256), F.lit(8))
    stem, suffix = path_stem(F.col("path")), path_suffix(F.col("path"))
    named = files.withColumns(
        {
            "_plain": F.when(name != "", F.concat_ws("/", "kind", name)),
            "_digest": F.concat("kind", F.lit("/"), F.when(name == "", "file").otherwise(stem), F.lit("-"), digest, suffix),
        }
    )
    firsts = named.where(F.col("_plain").isNotNull()).groupBy("session", "_plain").agg(F.min("path").alias("_owner"))
    judged = lookup(named, firsts, ["session", "_plain"], spread_by=["path"]).withColumn(
        "_late", F.coalesce(F.col("path") != F.col("_owner"), F.lit(True))
    )
    taken = judged.where("_late").groupBy("session", F.col("_digest").alias("_plain")).agg(F.min("path").alias("_taken"))
    final = lookup(judged, taken, ["session", "_plain"], spread_by=["path"])
    collides = F.col("_late") | F.coalesce(F.col("_taken") < F.col("path"), F.lit(False))
    return final.withColumn("arcname", F.when(collides, F.col("_digest")).otherwise(F.col("_plain"))).drop(
        "_plain", "_digest", "_owner", "_late", "_taken"
    )


def totals(attachments: DataFrame) -> DataFrame:
    """Bytes and counts per session."""
    kept = F.col("outcome") == "file"
    return attachments.groupBy("session").agg(
        F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("total_bytes"),
        F.count_if(kept).alias("files"),
        F.count_if(F.col("outcome") == "missing").alias("missing"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )
