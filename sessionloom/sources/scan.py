"""A whole corpus from session folders: one description of what to read per dialect."""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.text import unify_line_breaks
from sessionloom.operators.launch import event_verdict
from sessionloom.operators.sessions import sessions
from sessionloom.sources import cursor
from sessionloom.sources.dialect import Dialect, messages, read_events
from sessionloom.sources.files import (
    decode_lines, file_inventory, in_order, located, lossy_text, parsed, read_lines, read_texts, split_lines,
)
from sessionloom.sources.registry import DIALECTS, union_all


class CorpusScan:
    """DataFrames over the files of one dialect, known by its id or given. Nothing is read until a result is used.

    Each result reads a file once: the summary, the header and the launch label of a
    session come out of one aggregate over one parse of its lines.

    `modified_since` limits every read to files changed at or after that time; the
    limit is applied to the file listing, so older files are not opened.

    Spark's file sources do not list files without a byte. Where those matter, pass
    an `inventory` of (path, size, modified), such as an object store's own: then
    an empty file is an empty session. Its paths name the store as Spark does.

    Where files are many and small and more than one result is wanted, use `kept`.
    """

    def __init__(
        self, spark: SparkSession, source: str | Dialect, root: str, modified_since=None, inventory: DataFrame | None = None
    ):
        self._inventory = inventory
        self.dialect = source if isinstance(source, Dialect) else DIALECTS[source]
        self.spark, self.root = spark, located(spark, root.rstrip("/"))
        self._layout = self.dialect.layout
        parent = self.root.rsplit("/", 1)[0]
        self._where = [self.root, *(f"{parent}/{name}" for name in self._layout.beside)]
        self._how = {"recursive": True, "modified_since": modified_since}
        self._kept: DataFrame | None = None

    def kept(self, folder: str) -> CorpusScan:
        """The same scan with its lines written to `folder` as a table now: the files of lines are listed and opened for
        that alone, however many results are taken. The lines of many small files come to a few files of the table."""
        lines, scan = self.lines(), copy(self)
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        lines.coalesce(tasks).write.parquet(folder)
        scan._kept = self.spark.read.schema(lines.schema).parquet(folder)
        return scan

    def files(self) -> DataFrame:
        """files(path, size, modified), each file once even where two layouts name it."""
        found = self._inventory
        if found is None:
            kinds = [g for g in (self._layout.lines, self._layout.texts) if g]
            glob = kinds[0] if len(kinds) == 1 else "{" + ",".join(kinds) + "}"
            found = file_inventory(self.spark, self._where, name_glob=glob, **self._how)
        return self._inside(found).dropDuplicates(["path"])

    def _inside(self, rows: DataFrame) -> DataFrame:
        """Rows of files that lie where transcripts of the dialect lie."""
        return self.dialect.discover(rows, self.root).select(*rows.columns)

    def lines(self) -> DataFrame:
        """lines(path, seq, raw) of JSON-line files; plain-text transcripts are read whole instead."""
        if self._kept is not None:
            return self._kept
        return read_lines(self.spark, self._where, name_glob=self._layout.lines, choose=self._inside, **self._how)

    def plain_texts(self) -> DataFrame:
        """transcripts(path, size, modified, content) of the files that hold plain text instead of lines."""
        return self._inside(read_texts(self.spark, self._where, name_glob=self._layout.texts, **self._how))

    def texts(self) -> DataFrame:
        """transcripts(path, size, modified, content) of every file of the dialect, for hashes and bundles."""
        kinds = [g for g in (self._layout.lines, self._layout.texts) if g]
        found = [read_texts(self.spark, self._where, name_glob=g, **self._how) for g in kinds]
        return self._inside(union_all(found))

    def decoded(self) -> DataFrame:
        return decode_lines(self.lines())

    def events(self) -> DataFrame:
        """What each line adds to its session, its launch verdict included."""
        events = read_events(self.decoded(), self.dialect, event_verdict(F.col("v")))
        if not self._layout.texts:
            return events
        turns = self._plain().select("path", F.posexplode(self.dialect.whole_text(F.col("text"))).alias("at", "turn"))
        role = F.col("turn.role")
        placed = turns.select(
            F.lit(self.dialect.id).alias("source"), "path", in_order(F.col("at")).alias("seq"), role.alias("role"),
            F.col("turn.text").alias("text"), F.lit(True).alias("counts"), (role == "user").alias("opens"),
        )
        return union_all([events, placed])

    def _plain(self) -> DataFrame:
        return self.plain_texts().select("path", lossy_text(F.col("content")).alias("text"))

    def messages(self) -> DataFrame:
        """messages(source, path, seq, role, text).

        Files of a dialect with plain-text transcripts are told apart by content:
        where no line is a JSON object the whole text is read as turns, whatever the
        file is called. For files of lines this takes a second look at the lines that
        hold no object; they come together per file, which otherwise is read as one
        row anyway.
        """
        spoken = messages(read_events(self.decoded(), self.dialect))
        if self.dialect.whole_text is None:
            return spoken
        parts = [spoken, self._of_texts(self._without_objects())]
        if self._layout.texts:
            parts.append(self._of_texts(self._plain()))
        return union_all([p.select(*spoken.columns) for p in parts])

    def _without_objects(self) -> DataFrame:
        """(path, text) of line files in which no line is a JSON object."""
        lines = self.lines().withColumn("plain", parsed(F.col("raw")).isNull())
        rest = F.collect_list(F.when(F.col("plain"), F.struct("seq", "raw")))
        whole = lines.groupBy("path").agg(F.bool_and("plain").alias("plain"), F.array_sort(rest).alias("lines"))
        return whole.where("plain").select("path", F.array_join(F.col("lines.raw"), "\n").alias("text"))

    def _of_texts(self, texts: DataFrame) -> DataFrame:
        """Messages of whole texts, each taken apart once: into JSON lines or into turns."""
        def part(raw=None, role=None, text=None):
            given = {"raw": raw, "role": role, "text": text}
            return F.struct(*[(F.lit(None) if c is None else c).cast("string").alias(name) for name, c in given.items()])

        lines = F.transform(F.split(unify_line_breaks(F.col("text")), "\n"), lambda line: part(raw=line))
        turns = F.transform(self.dialect.whole_text(F.col("text")), lambda t: part(role=t["role"], text=t["text"]))
        parts = texts.select("path", F.posexplode(F.when(cursor.holds_json(F.col("text")), lines).otherwise(turns)).alias("at", "part"))
        read = parts.select("path", in_order(F.col("at")).alias("seq"), "part", F.explode_outer(parsed(F.col("part.raw"))).alias("v"))
        v = F.col("v")
        role = F.coalesce("part.role", self.dialect.role(v))
        said = F.when(F.col("part.role").isNotNull(), F.col("part.text")).otherwise(self.dialect.text(v))
        rows = read.select(F.lit(self.dialect.id).alias("source"), "path", "seq", role.alias("role"), said.alias("text"))
        return rows.where(F.col("role").isNotNull())

    def pointers(self) -> DataFrame:
        """pointers(session, pointer, kind, place) that the dialect finds in its transcripts, if it looks for any."""
        lines = self.lines()
        if self._layout.texts:
            plain = split_lines(self._plain()).withColumn("seq", in_order(F.col("seq")))
            lines = lines.unionByName(plain)
        if self.dialect.attachments is None:
            shape = "session string, pointer string, kind string, place struct<phase:int,seq:struct<block:bigint,row:bigint>,at:int>"
            return self.spark.createDataFrame([], shape)
        return self.dialect.attachments(lines)

    def sessions(self) -> DataFrame:
        """Session rows with their own launch label."""
        return sessions(self.files(), self.events(), self.dialect, self.root)


def _scans(spark: SparkSession, roots: dict[str, str | CorpusScan], modified_since) -> list[CorpusScan]:
    given = [(s, roots[s]) for s in DIALECTS if s in roots]
    return [r if isinstance(r, CorpusScan) else CorpusScan(spark, s, r, modified_since) for s, r in given]


def scan_sessions(spark: SparkSession, roots: dict[str, str | CorpusScan], modified_since=None) -> DataFrame:
    """Session rows of all dialects that have a root, or a scan made before, in registry order."""
    return union_all([scan.sessions() for scan in _scans(spark, roots, modified_since)])


def scan_messages(spark: SparkSession, roots: dict[str, str | CorpusScan], modified_since=None) -> DataFrame:
    return union_all([scan.messages() for scan in _scans(spark, roots, modified_since)])
