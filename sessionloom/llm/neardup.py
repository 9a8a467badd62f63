"""Near-duplicate documents by b-bit MinHash.

Each text becomes the set of its distinct runs of five words. Of 128 minima per set, bands of four give candidates
and the two low bits of each minimum are packed into four words. Two packed signatures differ in few bits where the
sets are alike; the share of equal entries, corrected for the chance that unequal minima agree in two bits, estimates
the similarity and drops most candidates. The rest is confirmed on the full sets.

A group of thousands of near copies must not become all its pairs. Equal sets are folded into one first. Then each
bucket of a band is joined as a star to one member, a different one each round, and confirmed links merge components.
What is left are pairs of one bucket in different components; all of these are estimated inside the join and
confirmed, without a cap. Pairs inside a component cannot change it.

At similarity 0.75 all 32 bands miss with probability (1 - 0.75^4)^32 = 5e-6; the estimate cuts at five standard
deviations. Nulls and texts without words have the empty set and link with nothing. Rows with the same id are one
document with several texts. A row without an id links with nothing and is kept. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import RollingHash, Scratch, mix64, utf8_pieces
from sessionloom.llm.components import components

WORDS, PERMUTATIONS, BAND_ROWS = 5, 128, 4
BANDS = PERMUTATIONS // BAND_ROWS
STAR_ROUNDS = 2
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bits array<long>, bands array<long>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DRAW = np.random.Generator(np.random.PCG64(5))
_FACTOR = _DRAW.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_SHIFT = _DRAW.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_PLACE = _DRAW.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle keys of each text."""
    raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = RollingHash(raw).at(starts, stops)
    bounds = np.searchsorted(starts, offsets)
    full = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        full += words[k : k + len(full)] * _PLACE[k]
    full = mix64(full)
    found = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = last - first
        if n >= WORDS:
            own = np.sort(full[first : last - WORDS + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            found.append(own[keep])
        elif n:
            parts = np.append(words[first:last] * _PLACE[:n], np.arange(n, n + 1, dtype=np.uint64) * _PLACE[WORDS])
            found.append(mix64(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _minima(keys: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """PERMUTATIONS x texts minima of the permuted upper halves of the keys."""
    narrow = (keys >> np.uint64(32)).astype(np.uint32)
    out, work = np.empty((PERMUTATIONS, len(firsts)), np.uint32), np.empty_like(narrow)
    for k in range(PERMUTATIONS):
        np.multiply(narrow, _FACTOR[k], out=work)
        np.add(work, _SHIFT[k], out=work)
        out[k] = np.minimum.reduceat(work, firsts)
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """texts x 4: two bit planes of 128 entries, from the low bits of the scattered minima."""
    low = (mix64(minima) & np.uint64(3)).astype(np.uint8)
    planes = [np.packbits(low >> k & 1, axis=0, bitorder="little") for k in (0, 1)]
    return np.concatenate([np.ascontiguousarray(p.T).view("<i8") for p in planes], axis=1)


def _bands(minima: np.ndarray) -> np.ndarray:
    """texts x BANDS keys; the band takes part."""
    rows = minima.reshape(BANDS, BAND_ROWS, -1).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[:, None] + np.uint64(1)
    for k in range(BAND_ROWS):
        key = mix64(key * _PLACE[k] + rows[:, k])
    return key.T.view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    width = values.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, width, dtype=np.int32), pa.array(values.ravel()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, offsets in utf8_pieces(batch.column(1)):
            sets = shingles(raw, offsets)
            sizes = np.array([len(s) for s in sets], np.int64)
            bits = np.zeros((len(sets), 4), np.int64)
            bands = np.zeros((len(sets), BANDS), np.int64)
            whole = np.zeros((2, len(sets)), np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                keys = np.concatenate([sets[i] for i in full])
                firsts = np.cumsum(sizes[full]) - sizes[full]
                minima = _minima(keys, firsts)
                bits[full], bands[full] = _packed(minima), _bands(minima)
                for k in (0, 1):
                    whole[k, full] = np.add.reduceat(mix64(keys * _PLACE[k]), firsts)
            yield pa.record_batch(
                [batch.column(0)[first:last], pa.array(sizes), *(pa.array(w.view(np.int64)) for w in whole), _lists(bits), _lists(bands)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bits", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, offsets in utf8_pieces(batch.column(1)):
            sets = shingles(raw, offsets)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            keys = np.concatenate(sets).view(np.int64)
            yield pa.record_batch([batch.column(0)[first:last], pa.ListArray.from_arrays(ends, pa.array(keys))], names=["id", "keys"])


def signatures(docs: DataFrame) -> DataFrame:
    """SIGNATURE of every row; bits and bands are zero for an empty set."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign, SIGNATURE)


def _alike(a: str, b: str, least: float) -> Column:
    """Estimated similarity of two packed signatures reaches `least`."""
    x = [F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i]) for i in range(4)]
    unequal = F.bit_count(x[0].bitwiseOR(x[2])) + F.bit_count(x[1].bitwiseOR(x[3]))
    return unequal <= F.lit(int(PERMUTATIONS * 0.75 * (1 - least)))


def _reaches(one: Column, two: Column, percent: int) -> Column:
    """The similarity of two full sets reaches the limit; sizes are compared first, as most pairs fail there or not at all.

    The intersection stands here once: an expression used twice would be computed before the conditions that guard it."""
    small, large = F.least(F.size(one), F.size(two)), F.greatest(F.size(one), F.size(two))
    return (100 * small >= percent * large) & ((100 + percent) * F.size(F.array_intersect(one, two)) >= percent * (F.size(one) + F.size(two)))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("id").alias("a"), F.col("keys").alias("ka"))
    two = sets.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
    return pairs.join(one, "a").join(two, "b").where(_reaches(F.col("ka"), F.col("kb"), percent)).select("a", "b")


def _across(left: DataFrame, nodes: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """All links between components that share a bucket.

    A document without any link meets every near copy of its group here, so these pairs are estimated and confirmed in
    the condition of the join and only links become rows. A pair is looked at in the first band it shares."""
    held = left.join(nodes.select("id", "bands"), "id").join(sets, "id")
    one, two = held.alias("m"), held.alias("c")
    first = F.array_position(F.zip_with("m.bands", "c.bands", lambda x, y: x == y), True)
    here = F.array_position(F.col("m.bands"), F.col("m.key"))
    met = one.join(
        two,
        (F.col("m.key") == F.col("c.key")) & (F.col("m.label") < F.col("c.label")) & _alike("m", "c", least) & (first == here)
        & _reaches(F.col("m.keys"), F.col("c.keys"), percent),
    )
    return met.select(F.least("m.id", "c.id").alias("a"), F.greatest("m.id", "c.id").alias("b")).where("a <> b").distinct()


def links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(id, label): components of the nodes that have any link."""
    spark = docs.sparkSession
    banded = nodes.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = banded.join(shared, "key")
    members = scratch.keep(met.join(nodes.select("id", "bits"), "id").select("key", "id", "bits"), "members")
    wanted = members.select("id").distinct()
    sets = scratch.keep(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "id long, keys array<long>"), "sets",
    )
    least = percent / 100 - 5 * 0.046
    labels = spark.createDataFrame([], "id long, label long")
    confirmed = tried = None
    for step in range(STAR_ROUNDS + 1):
        known = members.join(labels, "id", "left").select("key", "id", "bits", F.coalesce("label", "id").alias("label"))
        split = known.groupBy("key").agg(
            F.min_by(F.struct("id", "bits", "label"), F.xxhash64("id") if not step else F.xxhash64("id", "key", F.lit(step))).alias("c"),
            F.min("label").alias("lo"), F.max("label").alias("hi"),
        ).where("lo < hi")
        if step < STAR_ROUNDS:
            met = known.alias("m").join(split.select("key", "c.*").alias("c"), (F.col("m.key") == F.col("c.key")) & (F.col("m.label") != F.col("c.label")) & _alike("m", "c", least))
            pairs = met.select(F.least("m.id", "c.id").alias("a"), F.greatest("m.id", "c.id").alias("b")).where("a <> b").distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = scratch.keep(pairs, f"pairs{step}")
            tried = pairs if tried is None else tried.union(pairs)
            good = scratch.keep(_confirm(pairs, sets, percent), f"links{step}")
        else:
            left = scratch.keep(known.join(split.select("key"), "key", "left_semi"), "left")
            good = scratch.keep(_across(left, nodes, sets, least, percent), "across")
        confirmed = good if confirmed is None else confirmed.union(good)
        labels = components(confirmed, scratch, f"labels{step}")
    return labels


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.keep(signatures(docs), "signed")
    able = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = scratch.keep(
        able.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "nodes"
    )
    labels = links(docs, nodes, scratch, percent)
    # An id with several texts belongs to several sets; each of its sets then reaches the others.
    classes = nodes.select("set_a", "set_b", "id").join(labels, "id", "left").select("set_a", "set_b", F.coalesce("label", "id").alias("label"))
    found = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = F.when(linked, F.col("label")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op3_near_duplicates(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM w),
x AS (SELECT doc_id, len(k) AS n, unnest(k) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a)
SELECT s.doc_id, len(k) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT id, min(seen) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""
