"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale each; what rounding took from a vector is known exactly as a length.
For u = r + e with quantised part r and rest e, |u.v - r.s| <= |r||f| + |e||s| + |e||f|, so the int8 product of two
vectors bounds their cosine from both sides. Pairs surely above the threshold are links, pairs surely below are not,
and only those between are computed again in double precision from the vectors as they came. Products of whole
numbers below 2^24 are exact in single precision, which lets the tile run as a plain matrix product.

Equal vectors are folded into one first. Vectors are dealt to fragments of a fixed size, and each pair of fragments is
one group, so a task holds two fragments whatever the size of the table. Inside a group rows are ordered by their
nearest direction of a fixed set; tiles whose centres lie too far apart for their radii are skipped. A group returns a
count of links per vector and a few edges that connect what is linked; pairs are never written, so a cluster with a
third of all rows costs no more than any other tile. All pairs of fragments are met: work grows with the square of the
number of distinct vectors, as a search without misses must where vectors have no order to prune by.

Defined results: null, empty and zero vectors and those with a null or non-finite component link with nothing, nor do
rows without an id. Vectors of different lengths do not link. Repeated rows are rows of their own and link with each
other. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch
from sessionloom.llm.components import components

FRAGMENT_ROWS, TILE_A, TILE_B, DIRECTIONS = 4096, 256, 1024, 32
THRESHOLD = 0.9


class _Side:
    """Quantised vectors of one fragment in the order of their cells."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("id").to_numpy()
        raw = table.column("embedding").combine_chunks()
        values = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        scaled = values / np.abs(values).max(axis=1, keepdims=True)  # keeps squares of tiny or huge components finite
        unit = scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
        axes = np.random.Generator(np.random.PCG64(3)).standard_normal((DIRECTIONS, unit.shape[1]))
        order = np.lexsort((ids, np.argmax(unit @ axes.T, axis=1)))
        self.ids, self.copies, self.unit = ids[order], table.column("copies").to_numpy()[order], unit[order]
        self.scale = np.abs(self.unit).max(axis=1) / 127
        whole = np.rint(self.unit / self.scale[:, None])
        self.codes = whole.astype(np.int8)
        part = whole * self.scale[:, None]
        self.length = np.sqrt(np.einsum("ij,ij->i", part, part)) + 1e-12
        rest = self.unit - part
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) + 1e-12
        self.links = np.zeros(len(ids), np.int64)
        self.label = self.ids.copy()

    def tiles(self, size: int) -> list[tuple[slice, np.ndarray, float]]:
        found = []
        for k in range(0, len(self.ids), size):
            rows = slice(k, min(k + size, len(self.ids)))
            centre = self.unit[rows].mean(axis=0)
            found.append((rows, centre, float(np.sqrt(((self.unit[rows] - centre) ** 2).sum(axis=1)).max())))
        return found


def _linked(a: _Side, b: _Side, rows: slice, columns: slice, least: float) -> np.ndarray | None:
    """Matrix of linked pairs of two tiles; None where there is none."""
    kind = np.float32 if a.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = a.codes[rows].astype(kind) @ b.codes[columns].astype(kind).T
    worst = float((a.length[rows].max() + a.error[rows].max()) * b.error[columns].max() + a.error[rows].max() * b.length[columns].max())
    if product.max() * a.scale[rows].max() * b.scale[columns].max() < least - worst - 1e-6:
        return None
    cosine = product.astype(np.float64) * a.scale[rows][:, None] * b.scale[columns]
    bound = a.length[rows][:, None] * b.error[columns] + a.error[rows][:, None] * (b.length[columns] + b.error[columns]) + 1e-9
    linked = cosine - bound >= least
    i, j = np.nonzero((cosine + bound >= least) & ~linked)
    for k in range(0, len(i), 1 << 15):  # pairs possibly above: full precision
        x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        exact = np.einsum("ij,ij->i", a.unit[rows][x], b.unit[columns][y])
        linked[x, y] = exact >= least
    return linked if linked.any() else None


def _meet(a: _Side, b: _Side, rows: slice, columns: slice, linked: np.ndarray, edges: list[np.ndarray]) -> None:
    """Count links and let labels of linked rows become equal; each change of a label is an edge."""
    a.links[rows] += linked @ b.copies[columns]
    b.links[columns] += linked.T @ a.copies[rows]
    x, y = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    small, top = linked[np.ix_(x, y)], np.iinfo(np.int64).max
    la, lb = a.label[rows][x], b.label[columns][y]
    before = la.copy(), lb.copy()
    while True:
        na = np.minimum(la, np.where(small, lb, top).min(axis=1))
        nb = np.minimum(lb, np.where(small, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    for old, new in zip(before, (la, lb), strict=True):
        if (old != new).any():
            edges.append(np.unique(np.stack([old, new], axis=1)[old != new], axis=0))
    a.label[rows.start + x] = np.minimum(a.label[rows.start + x], la)
    b.label[columns.start + y] = np.minimum(b.label[columns.start + y], lb)


def _group(table: pa.Table, least: float) -> pa.Table:
    gi, gj = table.column("gi")[0].as_py(), table.column("gj")[0].as_py()
    fragment = table.column("fragment").to_numpy()
    a = _Side(table.filter(pa.array(fragment == gi))) if (fragment == gi).any() else None
    b = a if gi == gj else (_Side(table.filter(pa.array(fragment == gj))) if (fragment == gj).any() else None)
    edges: list[np.ndarray] = []
    if a is not None and b is not None:
        reach = math.sqrt(2 - 2 * least) + 1e-9
        for rows, ca, ra in a.tiles(TILE_A):
            for columns, cb, rb in b.tiles(TILE_B):
                if a is b and columns.stop <= rows.start + 1:
                    continue
                if math.sqrt(float(((ca - cb) ** 2).sum())) > ra + rb + reach:
                    continue
                linked = _linked(a, b, rows, columns, least)
                if linked is None:
                    continue
                if a is b:  # each pair once
                    linked &= np.arange(rows.start, rows.stop)[:, None] < np.arange(columns.start, columns.stop)
                if linked.any():
                    _meet(a, b, rows, columns, linked, edges)
    sides = [s for s in ({id(s): s for s in (a, b) if s is not None}).values()]
    counted = [np.stack([np.zeros(int((s.links > 0).sum()), np.int64), s.ids[s.links > 0], s.links[s.links > 0]], axis=1) for s in sides]
    joined = [np.concatenate([np.ones((len(e), 1), np.int64), e], axis=1) for e in edges]
    out = np.concatenate([np.zeros((0, 3), np.int64), *counted, *joined])
    return pa.table({"kind": out[:, 0], "a": out[:, 1], "b": out[:, 2]})


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding); 0 < threshold <= 1."""
    scratch = Scratch(rows.sparkSession, "vectors")
    held = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    held = held.withColumn("usable", usable)
    nodes = scratch.keep(
        held.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "nodes"
    )
    fragments = max(1, math.ceil(nodes.count() / fragment_rows))
    dealt = nodes.withColumn("fragment", F.pmod(F.xxhash64("id"), F.lit(fragments)).cast("int")).withColumn("size", F.size("embedding"))
    other = F.explode(F.sequence(F.lit(0), F.lit(fragments - 1)))
    paired = dealt.withColumn("other", other).select(
        "size", F.least("fragment", "other").alias("gi"), F.greatest("fragment", "other").alias("gj"), "fragment", "id", "copies", "embedding"
    )
    found = scratch.keep(
        paired.groupBy("size", "gi", "gj").applyInArrow(lambda t: _group(t, threshold), "kind long, a long, b long"), "found"
    )
    links = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    labels = components(found.where("kind = 1").select("a", "b"), scratch, "labels")
    known = nodes.join(links, "id", "left").join(labels, "id", "left").select(
        F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "id").alias("label")
    )
    result = held.join(known, F.col("usable") & (F.col("embedding") == F.col("e")), "left")
    own = F.coalesce("label", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
    )


def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS id, vec_id AS seen FROM v UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT id, min(seen) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = a LEFT JOIN c ON vec_id = c.id
"""
