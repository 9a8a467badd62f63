"""Tables of versions: replaced as a whole, changed by key, or appended by batch; readers take what is complete.

A version is complete when its write has committed, which leaves a marker file.
No table is ever changed in place, so a reader or a failed writer sees either the
old version or the new one. Writing a version again replaces just that version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), _schema(schema)

    def _complete(self) -> list[int]:
        """Numbers of committed versions; asks the file system that holds the folder."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version=*/_SUCCESS")
        found = path.getFileSystem(conf).globStatus(path)
        names = [status.getPath().getParent().getName() for status in (found or [])]
        return sorted(int(n.split("=", 1)[1]) for n in names)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest complete version, optionally below a number; empty if there is none.

        A version whose columns are not the expected ones is treated as absent.
        """
        known = [v for v in self._complete() if before is None or v < before]
        if known:
            try:
                stored = self.spark.read.parquet(f"{self.folder}/version={known[-1]}")
            except PySparkException:
                return self.empty()
            types = {f.name: f.dataType for f in stored.schema.fields}
            if all(types.get(f.name) == f.dataType for f in self.schema.fields):
                return stored.select(*self.schema.names)
        return self.empty()

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: int) -> DataFrame:
        """Write one version and read it back, which also cuts the plan behind it."""
        target = f"{self.folder}/version={version}"
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        typed.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(self.schema).parquet(target)


@dataclass
class Head:
    """What a version of a keyed table consists of, bucket by bucket."""

    version: int
    buckets: int
    base: dict[int, int] = field(default_factory=dict)  # version of the bucket's whole rows
    upto: dict[int, int] = field(default_factory=dict)  # changes of later versions apply on top
    rows: dict[int, int] = field(default_factory=dict)
    later: dict[int, int] = field(default_factory=dict)  # changed rows on top
    changes: list[int] = field(default_factory=list)  # versions that wrote changes and may still apply
    written: int = 0  # rows that this version wrote


class KeyedTable:
    """Rows by key, in buckets of a hash of the key. A version writes the rows that it changes.

    Every bucket has whole rows of some version and, on top, changed or removed rows of later ones. A reader takes
    the newest change of each key and the whole rows of all other keys; only changes are grouped, and the whole rows meet
    their keys alone. When a bucket's changes exceed a COMPACT_SHARE-th of it, or have waited for MOST_WAITING versions, that
    bucket alone is written whole again, so over time a changed row is written a bounded number of times and a reader
    meets a bounded number of changes. A small head per version, one row per bucket, says what applies; it is
    written last, and nothing that an earlier head names is touched before two later ones stand. Writing a version again replaces
    just that version. `buckets` holds for a new table; each should fit a task.
    """

    BUCKETS, COMPACT_SHARE, MOST_WAITING = 16, 4, 64
    HEAD = "bucket int, base bigint, upto bigint, rows bigint, later bigint, buckets int, written bigint, changes array<bigint>, columns string"

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), _schema(schema)
        self.keys, self.buckets = list(keys), buckets
        self.stored = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType())])

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/version={version}"

    def _versions(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/heads/version=*/_SUCCESS")
        found = path.getFileSystem(conf).globStatus(path)
        return sorted(int(s.getPath().getParent().getName().split("=", 1)[1]) for s in (found or []))

    def head(self, before: int | None = None) -> Head | None:
        """The newest complete head, optionally below a version. A table of other columns is an error, not an empty table."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return None
        rows = self.spark.read.schema(self.HEAD).parquet(self._path("heads", known[-1])).collect()
        if rows[0].columns != self.schema.simpleString():
            raise ValueError(f"{self.folder} has other columns: {rows[0].columns}")
        held = Head(known[-1], rows[0].buckets, changes=list(rows[0].changes), written=rows[0].written)
        for r in rows:
            if r.bucket is not None:
                held.base[r.bucket], held.upto[r.bucket], held.rows[r.bucket], held.later[r.bucket] = r.base, r.upto, r.rows, r.later
        return held

    def _at(self, kind: str, versions: Sequence[int]) -> DataFrame:
        full = T.StructType([*self.stored.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
        if not versions:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/{kind}").parquet(*[self._path(kind, v) for v in sorted(versions)])

    def _key(self) -> Column:
        return F.to_json(F.struct(*self.keys))

    @staticmethod
    def _of(values: dict[int, int]) -> Column:
        """The bucket's value; -1 for a bucket without one. Only partition columns are used, so other folders are not read."""
        pairs = [F.lit(x) for b, v in values.items() for x in (b, v)]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("bucket")), F.lit(-1)) if pairs else F.lit(-1)

    def _merged(self, head: Head) -> DataFrame:
        names = self.schema.names
        base = self._at("base", sorted(set(head.base.values()))).where(F.col("version") == self._of(head.base)).select(*names, "bucket")
        later = self._at("changes", head.changes).where(F.col("version") > self._of(head.upto))
        if not any(head.later.values()):
            return base
        newest = later.withColumn("_key", self._key()).groupBy("_key").agg(F.max_by(F.struct(*names, "bucket", "_gone"), "version").alias("_row"))
        kept = base.withColumn("_key", self._key()).join(newest.select("_key"), "_key", "left_anti").select(*names, "bucket")
        return kept.unionByName(newest.where("NOT _row._gone").select("_row.*").drop("_gone"))

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of the newest complete version, optionally below a number; empty if there is none."""
        head = self.head(before)
        return self._merged(head).select(*self.schema.names) if head else self.spark.createDataFrame([], self.schema)

    def _write(self, kind: str, version: int, rows: DataFrame) -> dict[int, int]:
        """Write rows with `bucket`, dealt by it; rows per bucket."""
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(kind, version))
        return dict(self._at(kind, [version]).groupBy("bucket").agg(F.count("*")).collect())

    def upsert(self, rows: DataFrame, version: int, gone: DataFrame | None = None) -> Head:
        """Replace or add the rows given, unique by key, and remove the keys of `gone`; all other rows stay unwritten."""
        before = self.head(version)
        head = Head(version, before.buckets if before else self.buckets)
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(False).alias("_gone"))
        if gone is not None:
            typed = typed.unionByName(gone.select(*self.keys, F.lit(True).alias("_gone")), allowMissingColumns=True)
        dealt = typed.withColumn("bucket", F.pmod(F.xxhash64(self._key()), F.lit(head.buckets)).cast("int"))
        if before is None:
            head.rows = self._write("base", version, dealt.where("NOT _gone"))
            head.base, head.upto, head.later = dict.fromkeys(head.rows, version), dict.fromkeys(head.rows, version), dict.fromkeys(head.rows, 0)
            head.written = sum(head.rows.values())
        else:
            fresh = self._write("changes", version, dealt)
            head.base, head.upto, head.rows, head.changes = dict(before.base), dict(before.upto), dict(before.rows), [*before.changes, version]
            head.later = {b: before.later.get(b, 0) + fresh.get(b, 0) for b in {*before.later, *fresh}}
            full = [b for b, n in head.later.items() if n and (n * self.COMPACT_SHARE > head.rows.get(b, 0) or version - head.upto.get(b, -1) >= self.MOST_WAITING)]
            head.written = sum(fresh.values())
            if full:
                whole = self._write("base", version, self._merged(head).where(F.col("bucket").isin(full)).withColumn("_gone", F.lit(False)))
                head.written += sum(whole.values())
                for b in full:
                    head.rows[b], head.later[b], head.base[b], head.upto[b] = whole.get(b, 0), 0, version, version
            head.upto |= {b: version for b, n in head.later.items() if not n}
            oldest = min((head.upto.get(b, -1) for b, n in head.later.items() if n), default=version)
            head.changes = [v for v in head.changes if v > oldest]
        self._commit(head)
        self._forget(head, before)
        return head

    def _commit(self, head: Head) -> None:
        same = (head.buckets, head.written, head.changes, self.schema.simpleString())
        rows = [(b, head.base.get(b, -1), head.upto.get(b, -1), head.rows.get(b, 0), head.later.get(b, 0), *same) for b in sorted({*head.base, *head.later})]
        frame = self.spark.createDataFrame(rows or [(None, None, None, None, None, *same)], self.HEAD)
        frame.coalesce(1).write.mode("overwrite").parquet(self._path("heads", head.version))

    def _forget(self, head: Head, before: Head | None) -> None:
        """Delete versions that neither this head nor the one before it names."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        heads = [h for h in (head, before) if h]
        named = {"base": {v for h in heads for v in h.base.values()}, "changes": {v for h in heads for v in h.changes}, "heads": {h.version for h in heads}}
        for kind, kept in named.items():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/version=*")
            system = path.getFileSystem(conf)
            for status in system.globStatus(path) or []:
                number = int(status.getPath().getName().split("=", 1)[1])
                if number < head.version and number not in kept:
                    system.delete(status.getPath(), True)


class BatchTable:
    """Rows appended per batch; running a batch again replaces that batch alone."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), _schema(schema)

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        target = f"{self.folder}/batch_id={batch_id}"
        rows.select(*self.schema.names).write.mode("overwrite").parquet(target)
        return self.spark.read.schema(self.schema).parquet(target)

    def read(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch_id=*/_SUCCESS")
        if not (path.getFileSystem(conf).globStatus(path) or []):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.folder)


def current_bundles(members: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """The members of each key from its newest batch; with results(object_key, batch_id), from its newest batch that was uploaded."""
    done = members if results is None else results.select(F.col("object_key").alias("key"), "batch_id")
    newest = done.groupBy("key").agg(F.max("batch_id").alias("batch_id"))
    return members.join(newest, ["key", "batch_id"])
