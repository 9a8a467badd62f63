"""Choosing files under a size budget: in order, skipping what no longer fits.

Where no group is large, each is folded as one array. Otherwise the rows are
partitioned by ranges of their order, and each range is walked once, row by row,
with what its current group has spent. A range boundary cuts one group at most;
these few are chosen anew: small ones folded, large ones in phases, so that no
group is ever brought together. Within a phase the room lies between h and 2h.
Files of at most h always fit, so their running sum decides; the first larger
file that fits ends the phase, as does the running sum reaching h. Each phase at
least halves the room, so a budget of 100 MiB needs some 28 phases whatever the
number of files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators.joins import lookup
from sessionloom.session import checkpoint_folder

DEFAULT_BUDGET = 100 * 1024 * 1024
FOLD_LIMIT = 4096


def within_budget(
    files: DataFrame, budget: int = DEFAULT_BUDGET, fold_limit: int = FOLD_LIMIT, checkpoint_dir: str | None = None, stored: bool = False
) -> DataFrame:
    """Adds `kept` to files(session, kind, path, size, …), taken per session by (kind, path).

    The files are written before they are counted and chosen, unless they are `stored` already."""
    budget = max(0, budget)
    work = f"{checkpoint_folder(files.sparkSession, checkpoint_dir)}/budget-{uuid.uuid4().hex}"
    if not stored:
        files = written(files, f"{work}/files")
    if _large(files, fold_limit).isEmpty():
        return _folded(files, budget)
    return _ranged(files, budget, fold_limit, work)


def written(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _large(files: DataFrame, fold_limit: int) -> DataFrame:
    return files.groupBy("session").agg(F.count("*").alias("_n")).where(F.col("_n") > fold_limit).select("session")


def _folded(files: DataFrame, budget: int) -> DataFrame:
    others = [c for c in files.columns if c not in ("session", "kind", "path", "size")]
    row = F.struct("kind", "path", "size", *others)
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast("array<boolean>").alias("kept"))

    def step(state: Column, file: Column) -> Column:
        fits = state["spent"] + file["size"] <= budget
        return F.struct(
            (state["spent"] + F.when(fits, file["size"]).otherwise(0)).cast("bigint").alias("spent"),
            F.array_append(state["kept"], fits).alias("kept"),
        )

    grouped = files.groupBy("session").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    chosen = grouped.select(
        "session", F.explode(F.arrays_zip("rows", F.aggregate("rows", start, step)["kept"].alias("kept"))).alias("z")
    )
    return chosen.select("session", *[F.col(f"z.rows.{c}").alias(c) for c in ("kind", "path", "size", *others)], F.col("z.kept").alias("kept"))


def _ranged(files: DataFrame, budget: int, fold_limit: int, work: str) -> DataFrame:
    """All sessions over ranges of rows; those that more than one range holds are chosen anew."""
    slices = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = files.repartitionByRange(slices, "session", "kind", "path").sortWithinPartitions("session", "kind", "path")
    # Partitions are ranges, so the running id is the order of all rows, kept by writing it.
    numbered = ranged.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    shape = T.StructType([*numbered.schema.fields, T.StructField("kept", T.BooleanType())])
    placed = written(numbered.mapInArrow(_walk(budget), shape), f"{work}/placed")

    one = F.struct("session")
    ends = placed.groupBy("_slice").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    held = ends.select("_slice", F.explode(F.array("first", "last")).alias("end")).select("_slice", "end.session")
    cut = written(held.groupBy("session").agg(F.count_distinct("_slice").alias("_n")).where("_n > 1").select("session"), f"{work}/cut")
    given = F.broadcast(cut.withColumnRenamed("session", "_cut"))
    same = F.col("session").eqNullSafe(F.col("_cut"))
    result = placed.join(given, same, "left_anti").select(*files.columns, "kept")
    if cut.isEmpty():
        return result
    again = placed.join(given, same, "left_semi").drop("kept")
    large = F.broadcast(_large(again, fold_limit))
    small = again.join(large, "session", "left_anti").select(*files.columns)
    result = result.unionByName(_folded(small, budget))
    phased = written(again.join(large, "session", "left_semi"), f"{work}/large")
    return result if phased.isEmpty() else result.unionByName(_phased(phased, files.columns, budget, work))


def _walk(budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds `kept` to rows in order, each session begun with the whole budget; a file without a size is neither kept nor left."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, current, spent = False, None, 0
        for batch in batches:
            kept = []
            for session, size in zip(batch.column("session").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if not begun or session != current:
                    begun, current, spent = True, session, 0
                fits = None if size is None else spent + size <= budget
                if fits:
                    spent += size
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], names=[*batch.schema.names, "kept"])

    return walk


def _phased(placed: DataFrame, columns: list[str], budget: int, work: str) -> DataFrame:
    """All large sessions at once, one written table per phase.

    The table of a phase holds every row still open with its verdict pending; what
    the phase settles and what stays open both follow from it and its few stops.
    """
    open_rows = placed.withColumn("_room", F.lit(budget).cast("bigint"))
    settled = []
    while True:
        running = written(_weigh(open_rows), f"{work}/phase-{len(settled)}")
        stops = running.where("_ends").groupBy("session").agg(
            F.min("_at").alias("_stop"), F.min_by("_left", "_at").alias("_next_room")
        )
        judged = lookup(running, stops, ["session"], spread_by=["path"])
        reached = F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop"))
        kept = F.col("_light") | F.col("_at").eqNullSafe(F.col("_stop"))
        settled.append(judged.where(reached).select(*columns, kept.alias("kept")))
        if running.where("_ends").isEmpty():
            break
        open_rows = judged.where(~reached).select(*placed.columns, F.col("_next_room").alias("_room"))
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result


def _weigh(rows: DataFrame) -> DataFrame:
    """Running sum of the light files of a phase, over slices first, and the rows that could end it."""
    room = F.col("_room")
    half = F.when(room == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(room)) - 1))
    weighed = rows.withColumn("_half", half).withColumn("_light", F.col("size") <= F.col("_half"))
    weighed = weighed.withColumn("_adds", F.when(F.col("_light"), F.col("size")).otherwise(0))
    before_slice = Window.partitionBy("session").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    in_slice = Window.partitionBy("session", "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = weighed.groupBy("session", "_slice").agg(F.sum("_adds").alias("_sum")).select(
        "session", "_slice", F.coalesce(F.sum("_sum").over(before_slice), F.lit(0)).alias("_base")
    )
    running = weighed.join(sums, ["session", "_slice"])
    left = room - F.col("_base") - F.coalesce(F.sum("_adds").over(in_slice), F.lit(0)) - F.col("size")
    ends = F.when(F.col("_light"), (room > 0) & (F.col("_left") <= F.col("_half"))).otherwise(F.col("_left") >= 0)
    return running.withColumn("_left", left).withColumn("_ends", ends).drop("_base", "_adds", "_half")
