"""Centroid clustering with bounds that are loosened by total displacement.

Each vector keeps its cluster, an upper bound of the distance to it and a lower bound for every other centroid, each
with the round in which it was last evaluated. All centroids so far are kept. In a later round a bound is loosened by how
far its centroid has come since that round, as one distance; the sum of the moves of single rounds, by which bounds are
loosened as a rule, is never less and most often much more. Where the upper bound stays below every lower bound nothing
is computed. Else the own distance is evaluated, then only the centroids whose bounds still fail, all in whole numbers,
so the result is the one of a full scan. Bounds are stored in single precision, rounded away from the truth.

Vectors are packed in blocks and written once, as a table bucketed by block; the state of each round is bucketed alike,
so the two meet without a shuffle and a round writes bounds, not vectors. Blocks report only vectors that have changed
their cluster, as differences of sums; tasks add them up before the shuffle, and k times d numbers reach the driver.
A written round needs no earlier one, and the state two rounds back is deleted.

Defined results: rows whose vector is null, has another number of components or holds a null or non-finite one have no
result. Components are limited to 2^60 in size after scaling. Ties go to the smaller number. Repeated rows are rows of their own; rows
of one id start in the order of their vectors. A row without an id is assigned and counted, but is no start. Fewer
starts than clusters give fewer clusters; without any start there is no result. A distance or an inertia beyond a long
is null. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch
from sessionloom.llm.whitening import exact, finite, matrix, whole

CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, "3"
BLOCK_ROWS, BUCKET_BLOCKS, MOST_BUCKETS = 1024, 64, 20_000
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK_ROWS vectors, each in the narrowest kind of integer that holds it."""
    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(k, BLOCK_ROWS)
            x = matrix(part.column(1), width)
            kind = np.min_scalar_type(-int(np.abs(x).max(initial=0)) - 1).str
            ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0))
            yield pa.record_batch(
                [pa.array([(task << 32) + count]), ids, pa.array([kind]), pa.array([x.astype(kind).tobytes()])], names=["block", "ids", "kind", "x"]
            )
            count += 1


def _squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(centroid).max(initial=0))
    most = len(centroid) * reach * reach
    if most < 1 << 51:  # whole numbers that doubles hold exactly
        away = x.astype(np.float64) - centroid
        return np.einsum("ij,ij->i", away, away).astype(np.int64)
    away = exact(x, most) - exact(centroid, most)
    return (away * away).sum(axis=1)


class Bounds:
    """What is known of one block: cluster, upper bound and k lower bounds per row, each with its round."""

    def __init__(self, rows: int, k: int, packed: bytes | None) -> None:
        self.k = k
        if packed is None:
            self.cluster = np.full(rows, -1, np.int32)
            self.upper, self.upper_at = np.full(rows, np.inf, np.float32), np.zeros(rows, np.uint16)
            self.lower, self.lower_at = np.zeros((rows, k), np.float32), np.zeros((rows, k), np.uint16)
        else:
            at = 0
            for name, kind, shape in (("cluster", np.int32, (rows,)), ("upper", np.float32, (rows,)), ("lower", np.float32, (rows, k)), ("upper_at", np.uint16, (rows,)), ("lower_at", np.uint16, (rows, k))):
                size = math.prod(shape)
                setattr(self, name, np.frombuffer(packed, kind, size, at).reshape(shape).copy())
                at += size * np.dtype(kind).itemsize

    def packed(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.cluster, self.upper, self.lower, self.upper_at, self.lower_at))

    def _raise(self, rows: np.ndarray, square: np.ndarray, now: int) -> None:
        self.upper[rows] = np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32), np.float32(np.inf))
        self.upper_at[rows] = now

    def _cut(self, rows: np.ndarray, j: np.ndarray | int, square: np.ndarray, now: int) -> None:
        self.lower[rows, j] = np.maximum(np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), 0)
        self.lower_at[rows, j] = now

    def assign(self, x: np.ndarray, history: np.ndarray, tighten: bool = False) -> tuple[int, np.ndarray | None]:
        """Move every row to its nearest centroid of the last round: (distances evaluated, own squares if `tighten`)."""
        now, k = len(history) - 1, self.k
        centroids, everyone = history[now], np.arange(len(x))
        come = np.sqrt(((history[now].astype(np.float64) - history.astype(np.float64)) ** 2).sum(axis=2)) * (1 + 1e-12)  # round x centroid
        fresh = self.cluster < 0
        own = np.where(fresh, 0, self.cluster)
        lower = self.lower - come[self.lower_at, np.arange(k)]
        lower[everyone, own] = np.inf
        lower[fresh, 1:] = -np.inf
        upper = np.where(fresh, np.inf, self.upper + come[self.upper_at, own])
        failed = (lower <= upper[:, None] * (1 + 1e-9)).any(axis=1)
        rows = everyone if tighten else np.flatnonzero(failed)
        if not len(rows):
            return 0, None
        # The own distance first: it alone settles many rows.
        best = np.zeros(len(rows), np.int64)
        for j in range(k):
            at = np.flatnonzero(own[rows] == j)
            if len(at):
                found = _squares(x[rows[at]], centroids[j])
                if found.dtype == object:
                    best = best.astype(object)
                best[at] = found
        evaluated = len(rows)
        self._raise(rows, best, now)
        held = self.upper[rows].astype(np.float64)
        open_ = lower[rows] <= held[:, None] * (1 + 1e-9)
        first, nearest, least = own[rows], own[rows].copy(), best.copy()
        for j in range(k):
            at = np.flatnonzero(open_[:, j])
            if not len(at):
                continue
            evaluated += len(at)
            square = _squares(x[rows[at]], centroids[j])
            if square.dtype == object:
                least = least.astype(object)
            self._cut(rows[at], j, square, now)
            better = (square < least[at]) | ((square == least[at]) & (j < nearest[at]))
            nearest[at[better]], least[at[better]] = j, square[better]
        moved = nearest != first
        self._cut(rows[moved], first[moved], best[moved], now)
        self._raise(rows[moved], least[moved], now)
        self.cluster[rows] = nearest
        return evaluated, least if tighten else None


def _vectors(batch: pa.RecordBatch, r: int, width: int) -> np.ndarray:
    names = batch.schema.names
    kind, raw = batch.column(names.index("kind"))[r].as_py(), batch.column(names.index("x"))[r].as_buffer()
    return np.frombuffer(raw, kind).reshape(-1, width).astype(np.int64)


def _state(batch: pa.RecordBatch, r: int, rows: int, k: int) -> Bounds:
    names = batch.schema.names
    return Bounds(rows, k, batch.column(names.index("state"))[r].as_py() if "state" in names else None)


def _differences(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[Decimal] | None:
    """k * (d + 1) changes of sums and counts by the rows that changed their cluster."""
    rows = np.flatnonzero(before != after)
    if not len(rows):
        return None
    wide = exact(x[rows], len(rows) * int(np.abs(x[rows]).max(initial=0)))
    wide = np.concatenate([wide, np.ones((len(rows), 1), np.int64).astype(wide.dtype)], axis=1)
    total = np.zeros((k, wide.shape[1]), wide.dtype)
    for j in range(k):
        total[j] = wide[after[rows] == j].sum(axis=0) - wide[before[rows] == j].sum(axis=0)
    return [Decimal(int(v)) for v in total.ravel()]


def _round(batches: Iterator[pa.RecordBatch], history: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    k = history.shape[1]
    for batch in batches:
        for r in range(batch.num_rows):
            x = _vectors(batch, r, width)
            known = _state(batch, r, len(x), k)
            before = known.cluster.copy()
            evaluated, _ = known.assign(x, history)
            yield pa.record_batch(
                [batch.column(batch.schema.names.index("block")).slice(r, 1), pa.array([known.packed()], pa.binary()), pa.array([evaluated]),
                 pa.array([_differences(x, before, known.cluster, k)], pa.list_(pa.decimal128(38, 0)))],
                names=["block", "state", "evaluated", "moved"],
            )


def _last(batches: Iterator[pa.RecordBatch], history: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    k = history.shape[1]
    for batch in batches:
        for r in range(batch.num_rows):
            x = _vectors(batch, r, width)
            known = _state(batch, r, len(x), k)
            _, squares = known.assign(x, history, tighten=True)
            ids = batch.column(batch.schema.names.index("ids"))[r].values
            yield pa.record_batch([ids, pa.array(known.cluster), pa.array([Decimal(v) for v in squares.tolist()], pa.decimal128(38, 0))], names=["vec_id", "cluster", "square"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] | None = None
    for batch in batches:
        for values in batch.column(0).to_pylist():
            total = [int(v) for v in values] if total is None else [a + int(b) for a, b in zip(total, values, strict=True)]
    if total is not None:
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], names=["cell", "v"])


class _Buckets:
    """Tables bucketed by block, in the run's own folder; the catalogue knows them only while the run lasts."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int) -> None:
        self.spark, self.scratch, self.buckets, self.names = spark, scratch, buckets, []

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        table = f"blocks_{uuid.uuid4().hex}"
        writer = frame.write.option("path", f"{self.scratch.folder}/{name}").option("compression", "zstd")
        writer.bucketBy(self.buckets, "block").sortBy("block").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def forget(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names = []


def starts(held: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose seeded id has the least digest, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = held.where("vec_id IS NOT NULL").select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.array([r.x for r in found], np.int64)


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: str = SEED) -> DataFrame:
    """RESULT for every usable row of (vec_id, embedding)."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "clustering")
    held = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    held = held.where(finite(F.col("e")) & (F.size("e") == width)).select("vec_id", whole(F.col("e"), scale).alias("x"))
    first = starts(held, clusters, seed)
    if not len(first):
        return spark.createDataFrame([], RESULT)
    history, k = first[None], len(first)
    sums, counts = np.zeros((k, width), object), [0] * k

    buckets = min(MOST_BUCKETS, max(1, math.ceil(held.count() / (BLOCK_ROWS * BUCKET_BLOCKS))))
    tables = _Buckets(spark, scratch, buckets)
    packed = held.mapInArrow(lambda it: _pack(it, width), "block long, ids array<long>, kind string, x binary")
    vectors = tables.keep(packed.repartition(buckets, "block"), "vectors")
    state = None
    for step in range(rounds):
        met = vectors.drop("ids") if state is None else vectors.drop("ids").join(state.select("block", "state"), "block")
        moved = met.mapInArrow(lambda it, h=history: _round(it, h, width), "block long, state binary, evaluated long, moved array<decimal(38,0)>")
        state = tables.keep(moved, f"state{step}")
        scratch.remove(f"state{step - 2}")
        cells = state.where("moved IS NOT NULL").select("moved").mapInArrow(_added, "cell int, v decimal(38,0)")
        found = cells.groupBy("cell").agg(F.sum("v").alias("v")).where("v <> 0").collect()
        if not found:  # nobody moved, so no centroid does
            break
        for cell, v in found:
            j, dimension = divmod(cell, width + 1)
            if dimension == width:
                counts[j] += int(v)
            else:
                sums[j, dimension] += int(v)
        new = [[int(s) // counts[j] for s in sums[j]] if counts[j] else history[-1][j].tolist() for j in range(k)]
        history = np.concatenate([history, np.array(new, np.int64)[None]])
    met = vectors if state is None else vectors.join(state.select("block", "state"), "block")
    done = scratch.keep(met.mapInArrow(lambda it, h=history: _last(it, h, width), "vec_id long, cluster int, square decimal(38,0)"), "assigned")
    tables.forget()
    for name in ("vectors", *(f"state{s}" for s in range(rounds))):
        scratch.remove(name)

    spread = dict(done.groupBy("cluster").agg(F.sum("square")).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    whole_or_null = lambda v: None if v is None or int(v) >= 1 << 63 else int(v)
    total = whole_or_null(sum(int(v) for v in spread.values()))
    return done.select(
        "vec_id", "cluster", F.expr("try_cast(square AS long)").alias("distance"),
        of([whole_or_null(spread.get(j)) for j in range(k)], "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _sql() -> str:
    parts = [
        f"""v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
          FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS j, x AS c FROM v WHERE vec_id IS NOT NULL
          QUALIFY j < {CLUSTERS})""",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT r, j, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
          FROM v CROSS JOIN c{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)""")
        if t < ROUNDS:
            parts.append(f"""e{t} AS (SELECT j, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{t} JOIN v USING (r)),
          s{t} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM e{t} GROUP BY j, i),
          n{t} AS (SELECT j, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM s{t} GROUP BY j),
          c{t + 1} AS MATERIALIZED (SELECT j, coalesce(n{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN n{t} USING (j))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (j)"""


OP12_SQL = _sql()
