"""Reading session files as lines, whole texts, bytes and inventories."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import variants as V
from sessionloom.functions.text import strip


def plain_path(path: Column) -> Column:
    """A file URI as the path a transcript would write."""
    bare = F.regexp_replace(path, r"^file:(?://)?(?=/)", "")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def located(spark: SparkSession, folder: str) -> str:
    """A folder as the beginning of the paths of its files: with its store, or bare where that is the local disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:(?://)?(?=/)", "", full)


def _reader(spark: SparkSession, recursive: bool, name_glob: str | None):
    reader = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader


def existing(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The paths or globs that match anything; an agent that is not installed has no folder.

    A plain path costs one request; only globs are listed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def matches(pattern: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        store = path.getFileSystem(conf)
        if not re.search(r"[*?{}\[\]\\]", pattern):
            return store.exists(path)
        return len(store.globStatus(path) or []) > 0

    return [p for p in ([paths] if isinstance(paths, str) else paths) if matches(p)]


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    recursive: bool = False,
    name_glob: str | None = None,
    modified_since: datetime | None = None,
    choose: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """lines(path, seq, raw): text files line by line.

    A large file is read by many tasks. `seq` orders lines within a file: the
    offset of the block a line was read from, then its position in that block.
    `choose` filters rows by `path`; it is applied before lines are numbered, so that
    the condition reaches the listing and other files are not opened.
    """
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], "path string, seq struct<block:bigint,row:bigint>, raw string")
    lines = _reader(spark, recursive, name_glob).text(there)
    if modified_since is not None:
        # A condition on file metadata alone is applied to the listing.
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(modified_since))
    named = lines.select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    return (named if choose is None else choose(named)).select(
        "path",
        F.struct("block", F.monotonically_increasing_id().alias("row")).alias("seq"),
        F.make_valid_utf8("value").alias("raw"),
    )


def read_texts(
    spark: SparkSession,
    paths: str | Sequence[str],
    recursive: bool = False,
    name_glob: str | None = None,
    modified_since: datetime | None = None,
) -> DataFrame:
    """transcripts(path, size, modified, content): one row per file, bytes kept for hashing."""
    raw = _binary(spark, paths, recursive, name_glob, modified_since)
    return raw.select(*_inventory_columns(), F.col("content"))


def file_inventory(
    spark: SparkSession,
    paths: str | Sequence[str],
    recursive: bool = False,
    name_glob: str | None = None,
    modified_since: datetime | None = None,
) -> DataFrame:
    """files(path, size, modified) without reading any content."""
    return _binary(spark, paths, recursive, name_glob, modified_since).select(*_inventory_columns())


def _binary(spark, paths, recursive, name_glob, modified_since) -> DataFrame:
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp, content binary")
    found = _reader(spark, recursive, name_glob).format("binaryFile").load(there)
    if modified_since is not None:
        found = found.where(F.col("modificationTime") >= F.lit(modified_since))
    # The source's own path column is not escaped, so that a percent sign in a name would be read as an escape.
    return found.select(plain_path(F.col("_metadata.file_path")).alias("path"), "length", "modificationTime", "content")


def _inventory_columns() -> list[Column]:
    return [
        F.col("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ]


def lossy_text(content: Column) -> Column:
    """Bytes as text, invalid sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def in_order(number: Column) -> Column:
    """A position in a text read whole, as the position of a line."""
    return F.struct(F.lit(0).cast("bigint").alias("block"), number.cast("bigint").alias("row"))


def parsed(raw: Column) -> Column:
    """The line's object as a list of one, otherwise NULL. What parses and starts with a brace
    is an object; the brace also spares the parser every other line."""
    clean = strip(raw)
    return F.when(clean.startswith("{") & clean.endswith("}"), V.documents(clean))


def decode_lines(lines: DataFrame) -> DataFrame:
    """Adds `v`, the JSON object of each line; blank lines and anything else are left out.

    The object comes out of a generator: filters on it stay above, where a plain
    column would be substituted into them and every line parsed once per filter.
    """
    return lines.select("*", F.explode(parsed(F.col("raw"))).alias("v"))


def quarantine(lines: DataFrame) -> DataFrame:
    """Lines that hold text but no usable object, with the reason."""
    clean = strip(F.col("raw"))
    reason = F.when(clean.startswith("{"), "not parsable").otherwise("not an object")
    return lines.where((clean != "") & parsed(F.col("raw")).isNull()).withColumn("reason", reason)


def split_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """lines(…, seq, raw) from whole texts already held in a column."""
    others = [c for c in texts.columns if c != text]
    return texts.select(*others, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("seq", "raw"))
