"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere are removed.

Suffixes are sorted blockwise, a bucket at a time, to a depth of 200 bytes; the whole suffix array never exists.

1. The least hashed 64-byte string among those in a window of 200 bytes is its anchor. Equal windows have equal anchors
   at the same place, so only windows whose anchor string occurs twice can repeat. Anchors are some 1.5 % of positions
   and only their hashes are shuffled.
2. Windows with one anchor are a stretch of neighbouring suffixes. It is cut in two, so that all windows of a part share
   a core of 132 bytes or more, and the core names the bucket. Parts equal in all their bytes are folded into one class;
   a class met twice repeats throughout and needs no sorting.
3. Buckets with several classes are sorted, many small ones in one block of bounded memory. In a bucket, suffixes that
   agree in their first and last 13 bytes are long ties. They are resolved by ranks: positions of the difference cover
   {0, 1, 3, 9} modulo 13 are ranked once per block by their next 188 bytes, and any two suffixes have a common distance
   under 13 at which both meet the cover.
4. A bucket with more than `bucket_rows` classes is not brought together: its windows are counted by a 128-bit digest,
   which combines before the shuffle. The result is the same.

Equal texts are folded first, so thousands of copies are one text. Defined results: null is the empty text; a text under
200 bytes loses nothing; repeated rows are copies of each other, also with equal or null ids. Extra columns are not
read. Anchor and core hashes only choose buckets; equality is that of bytes in a bucket and of 128-bit digests for
classes and whole texts. Long texts are read in segments when anchors are sought.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import RollingHash, Scratch, mix64, utf8_pieces

LENGTH, ANCHOR = 200, 64
WINDOW = LENGTH - ANCHOR + 1
HALF = WINDOW // 2  # windows starting up to this far before the anchor share what follows it
MODULUS, COVER = 13, (0, 1, 3, 9)
DEPTH = LENGTH - MODULUS + 1
BUCKET_ROWS, BLOCK_BYTES, SEGMENT = 4096, 1 << 19, 1 << 22


class Parts:
    """Stretches of windows with one anchor, over the texts of one piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        hashes = RollingHash(raw)
        n = len(raw)
        empty = np.zeros(0, np.int64)
        self.row = self.first = self.last = self.anchor = empty
        self.name = np.zeros(0, np.uint64)
        self.hashes = hashes
        if n < LENGTH:
            return
        at = np.arange(n - ANCHOR + 1)
        order = (hashes.at(at, at + ANCHOR) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
        reach = 1
        while 2 * reach <= WINDOW:
            order = np.minimum(order[:-reach], order[reach:])
            reach *= 2
        if reach < WINDOW:
            order = np.minimum(order[: len(order) - (WINDOW - reach)], order[WINDOW - reach :])
        anchor = (order & np.uint64(0xFFFFFF)).astype(np.int64)  # of the window that starts here
        sizes = np.diff(offsets)
        counts = np.maximum(sizes - LENGTH + 1, 0)
        row = np.repeat(np.arange(len(sizes)), counts)
        start = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        if not len(start):
            return
        anchor = anchor[start]
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
        head, tail = np.append(0, change + 1), np.append(change, len(start) - 1)
        self.row, self.first, self.last, self.anchor = row[head], start[head], start[tail], anchor[head]
        self.name = hashes.at(self.anchor, self.anchor + ANCHOR)


def segments(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, row added, byte added): a long text in overlapping segments, so that each window is in one."""
    if len(raw) <= SEGMENT or len(offsets) > 2:
        yield raw, offsets, 0, 0
        return
    for k in range(0, max(len(raw) - LENGTH + 1, 1), SEGMENT):
        part = raw[k : k + SEGMENT + LENGTH - 1]
        yield part, np.array([0, len(part)]), 0, k


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        for first, _, raw, offsets in utf8_pieces(batch.column(2)):
            for part, own, _, _ in segments(raw, offsets):
                found = Parts(part, own)
                yield pa.record_batch(
                    [pa.array(found.name.view(np.int64)), pa.array(a[first + found.row]), pa.array(b[first + found.row])], names=["name", "ka", "kb"]
                )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, so that they take less room where they are shuffled and written."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [(t.as_py() or "").encode("utf-8") for t in batch.column(2)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([squeeze(t) for t in texts], pa.binary())],
            names=["ka", "kb", "n_bytes", "sha256", "packed"],
        )


def _open(packed: pa.Array) -> Iterator[np.ndarray]:
    loose = zstandard.ZstdDecompressor().decompress
    for value in packed:
        yield np.frombuffer(loose(value.as_py()), np.uint8)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of candidate windows: core, digest of all bytes, place of the part and number of its windows."""
    for batch in batches:
        names = batch.column(3)
        for k, raw in enumerate(_open(batch.column(2))):
            wanted = np.sort(np.array(names[k].values.to_numpy(zero_copy_only=False), np.int64))
            for part, own, _, added in segments(raw, np.array([0, len(raw)])):
                found = Parts(part, own)
                if not len(found.name):
                    continue
                place = np.minimum(np.searchsorted(wanted, found.name.view(np.int64)), len(wanted) - 1)
                keep = wanted[place] == found.name.view(np.int64)
                anchor, low, high = found.anchor[keep], found.first[keep], found.last[keep]
                second = RollingHash(part, 1)
                for side in (0, 1):  # windows that start at most HALF before the anchor, then the others
                    first = np.maximum(low, anchor - HALF) if not side else low
                    last = high if not side else np.minimum(high, anchor - HALF - 1)
                    some = first <= last
                    s, e, at = first[some], last[some] + LENGTH, anchor[some]
                    if not len(s):
                        continue
                    core = (at, at - HALF + LENGTH) if not side else (at - HALF - 1, at - WINDOW + 1 + LENGTH)
                    core = mix64(found.hashes.at(*core) + np.uint64(side + 1))
                    windows = last[some] - s + 1
                    distance = (at - s).astype(np.uint64)
                    ua, ub = (mix64(h.at(s, e) + distance * np.uint64(0x9E3779B97F4A7C15)) for h in (found.hashes, second))
                    n = len(s)
                    yield pa.record_batch(
                        [pa.array(x) for x in (core.view(np.int64), ua.view(np.int64), ub.view(np.int64), np.full(n, batch.column(0)[k].as_py()), np.full(n, batch.column(1)[k].as_py()), s + added, windows, at - s)],
                        names=["core", "ua", "ub", "ka", "kb", "start", "windows", "distance"],
                    )


STRETCH = "core long, ua long, ub long, ka long, kb long, start long, windows long, distance long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the chosen parts of each text."""
    for batch in batches:
        for k, raw in enumerate(_open(batch.column(0))):
            chosen = batch.column(1)[k].values
            start, windows = (chosen.field(x).to_numpy() for x in ("start", "windows"))
            held = [raw[s : s + w - 1 + LENGTH].tobytes() for s, w in zip(start.tolist(), windows.tolist(), strict=True)]
            yield pa.record_batch(
                [*(chosen.field(x) for x in ("core", "ua", "ub", "windows", "distance", "classes")), pa.array(held, pa.binary())],
                names=["core", "ua", "ub", "windows", "distance", "classes", "held"],
            )


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Digest of the MODULUS bytes from each position, from two overlapping words of eight bytes."""
    eight = np.zeros(len(text), np.uint64)
    for k in range(8):
        eight[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    return mix64(mix64(eight[at]) * np.uint64(0x9E3779B97F4A7C15) + eight[at + MODULUS - 8])


def repeated_windows(held: list[bytes], bucket: np.ndarray, windows: np.ndarray, distance: np.ndarray) -> list[np.ndarray]:
    """For each part, which of its windows also begins in another part of its bucket.

    Windows of parts in one bucket are compared at equal distance from the anchor."""
    text = np.frombuffer(b"".join(held), np.uint8)
    sizes = np.array([len(h) for h in held])
    offsets = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(held)), windows)
    inside = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = offsets[part] + inside
    place = bucket[part].astype(np.uint64) * np.uint64(2 * WINDOW) + (distance[part] - inside).astype(np.uint64)
    key = mix64(mix64(mix64(place) + _words(text, at)) + _words(text, at + LENGTH - MODULUS))
    _, group, counts = np.unique(key, return_inverse=True, return_counts=True)
    repeated = np.zeros(len(at), bool)
    tied = np.flatnonzero(counts[group] > 1)
    if len(tied):
        at, group = at[tied], group[tied]
        residue = at % MODULUS
        covered = np.isin(np.arange(MODULUS), COVER)
        reached = [np.flatnonzero(covered[(residue + d) % MODULUS]) for d in range(MODULUS)]
        sample = np.unique(np.concatenate([at[r] + d for d, r in enumerate(reached)]))
        rank = np.zeros(len(sample), np.int64)
        rows = np.lib.stride_tricks.sliding_window_view(text, DEPTH)[sample]
        _, rank = np.unique(np.ascontiguousarray(rows).view(f"V{DEPTH}").ravel(), return_inverse=True)
        for d, r in enumerate(reached):
            found = rank[np.searchsorted(sample, at[r] + d)]
            _, same, many = np.unique(group[r] * (len(sample) + 1) + found, return_inverse=True, return_counts=True)
            repeated[tied[r[many[same] > 1]]] = True
    return np.split(repeated, np.cumsum(windows)[:-1])


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


RUNS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by core; whole buckets are gathered up to BLOCK_BYTES and sorted together."""
    rows: list[tuple] = []
    size, last, fresh = 0, None, 0

    def flush(block: list[tuple]) -> pa.RecordBatch:
        bucket = np.unique(np.array([r[0] for r in block]), return_inverse=True)[1]
        flags = repeated_windows([r[5] for r in block], bucket, np.array([r[3] for r in block]), np.array([r[4] for r in block]))
        ua, ub = pa.array([r[1] for r in block], pa.int64()), pa.array([r[2] for r in block], pa.int64())
        return pa.record_batch([pa.array([r[0] for r in block], pa.int64()), ua, ub, pa.array([_runs(f) for f in flags], RUNS)], names=["core", "ua", "ub", "runs"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if row[0] != last:
                if size >= BLOCK_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
                last = row[0]
            rows.append(row)
            size += len(row[5])
    if rows:
        yield flush(rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest per window of the parts in large buckets."""
    for batch in batches:
        for k, held in enumerate(batch.column(4)):
            raw = np.frombuffer(held.as_py(), np.uint8)
            at = np.arange(batch.column(3)[k].as_py())
            wa, wb = (RollingHash(raw, which).at(at, at + LENGTH).view(np.int64) for which in (0, 1))
            fixed = [np.full(len(at), batch.column(c)[k].as_py()) for c in range(3)]
            yield pa.record_batch([pa.array(x) for x in (*fixed, at, wa, wb)], names=["core", "ua", "ub", "at", "wa", "wb"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digests = [], [], []
        for raw, runs in zip(_open(batch.column(2)), batch.column(3), strict=True):
            change = np.zeros(len(raw) + 1, np.int32)
            for a, b in ((r["from"], r["to"]) for r in runs.as_py()):
                change[a] += 1
                change[b - 1 + LENGTH] -= 1
            gone = np.cumsum(change)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(_runs(gone))
            digests.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, RUNS), pa.array(digests)], names=["ka", "kb", "n_removed", "spans", "kept_sha256"]
        )


def repeated_bytes(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) for every row of (doc_id, text); spans are byte ranges."""
    scratch = Scratch(docs.sparkSession, "substrings")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(7), text).alias("kb"), text.alias("text"))
    names = keyed.select("ka", "kb", "text").mapInArrow(_names, "name long, ka long, kb long")
    packed = keyed.select("ka", "kb", "text").mapInArrow(_pack, "ka long, kb long, n_bytes long, sha256 string, packed binary")
    folded = packed.groupBy("ka", "kb").agg(*(F.first(c).alias(c) for c in ("n_bytes", "sha256", "packed")), F.count("*").alias("copies"))

    # 1. Anchor strings that occur twice. Copies of a text hold the same ones; they are found too and do no harm.
    names = scratch.keep(names, "names")
    twice = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    listed = names.join(twice, "name").groupBy("ka", "kb").agg(F.collect_set("name").alias("names"))
    texts = folded.join(listed, ["ka", "kb"], "left")
    possible = F.col("names").isNotNull()
    texts = scratch.keep(texts.withColumn("packed", F.when(possible, F.col("packed"))), "texts")

    # 2. Parts of candidate windows, folded into classes of equal bytes.
    parts = texts.where(possible).select("ka", "kb", "packed", "names").mapInArrow(_stretches, STRETCH)
    parts = scratch.keep(parts, "parts")
    place = F.struct("ka", "kb", "start", "windows", "distance")
    classes = parts.groupBy("core", "ua", "ub").agg(F.count("*").alias("met"), F.min(place).alias("one"))
    classes = scratch.keep(classes, "classes")
    open_cores = classes.groupBy("core").agg(F.count("*").alias("classes"), F.sum("met").alias("met")).where("classes > 1").select("core", "classes")
    unsettled = classes.join(open_cores, "core").select("core", "ua", "ub", "classes", "one.*")

    # 3. Suffixes of the open buckets, sorted by blocks.
    chosen = unsettled.groupBy("ka", "kb").agg(F.collect_list(F.struct("core", "ua", "ub", "start", "windows", "distance", "classes")).alias("chosen"))
    held = texts.where(possible).select("ka", "kb", "packed").join(chosen, ["ka", "kb"]).select("packed", "chosen").mapInArrow(
        _contexts, "core long, ua long, ub long, windows long, distance long, classes long, held binary"
    )
    held = scratch.keep(held, "held")
    small = held.where(F.col("classes") <= bucket_rows).select("core", "ua", "ub", "windows", "distance", "held")
    runs = "core long, ua long, ub long, runs array<struct<from:int,to:int>>"
    found = small.repartition("core").sortWithinPartitions("core").mapInArrow(_sort_buckets, runs)

    # 4. Buckets too large to be brought together: windows counted by digest.
    large = held.where(F.col("classes") > bucket_rows).select("core", "ua", "ub", "windows", "held")
    digests = large.mapInArrow(_digests, "core long, ua long, ub long, at long, wa long, wb long")
    double = digests.groupBy("wa", "wb").agg(F.count("*").alias("n")).where("n > 1").select("wa", "wb")
    at = digests.join(double, ["wa", "wb"], "left_semi").groupBy("core", "ua", "ub").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("from"), (F.col("at") + 1).cast("int").alias("to"))).alias("runs"))
    found = scratch.keep(found.unionByName(at), "found")

    # Every part takes what was found for its class; a class met twice repeats throughout.
    whole = classes.where("met > 1").select(
        "core", "ua", "ub", F.array(F.struct(F.lit(0).alias("from"), F.col("one.windows").cast("int").alias("to"))).alias("runs")
    )
    settled = found.join(classes.where("met > 1").select("core", "ua", "ub"), ["core", "ua", "ub"], "left_anti").where(F.size("runs") > 0).unionByName(whole)
    spread = parts.join(settled, ["core", "ua", "ub"]).select("ka", "kb", "start", F.explode("runs").alias("r"))
    ranges = spread.groupBy("ka", "kb").agg(F.collect_list(F.struct((F.col("start") + F.col("r.from")).alias("from"), (F.col("start") + F.col("r.to")).alias("to"))).alias("ranges"))
    cut = texts.where(possible & (F.col("copies") == 1)).select("ka", "kb", "packed").join(ranges, ["ka", "kb"]).mapInArrow(
        _cut, "ka long, kb long, n_removed long, spans array<struct<from:int,to:int>>, kept_sha256 string"
    )
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    all_bytes = F.array(F.struct(F.lit(0).alias("from"), F.col("n_bytes").cast("int").alias("to")))
    result = texts.drop("packed", "names").join(cut, ["ka", "kb"], "left").select(
        "ka", "kb", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, all_bytes).otherwise(F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>"))).alias("spans"),
        F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
    return keyed.select("doc_id", "ka", "kb").join(result, ["ka", "kb"]).drop("ka", "kb")


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_bytes(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
