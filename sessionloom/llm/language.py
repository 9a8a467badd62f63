"""Language identification by bitmasks of n-grams in a bit-sliced Bloom filter.

A slot of the filter is a mask with a bit per language. An n-gram looks up a few slots; the AND of their masks holds
all languages that know the n-gram. Of a text's n-grams the bits are counted per language, each count is corrected for
the share of unknown n-grams that pass the filter by chance, and the largest corrected count decides.

Learning counts the n-grams of all labelled texts, combined in the task and again before the shuffle. A language knows
its most frequent n-grams up to a capacity, without those that another language uses far more often: a few foreign or
mislabelled texts must not teach a language. The threshold comes from a histogram of counts, so no language's n-grams
are ever sorted in one place. Only filled slots reach the driver, at most as many as the filter has.

N-grams are those of lower-case letters with one space for whatever stands between. Defined results: a null text or
one without a letter is `und` with score 0; a text whose n-grams no language knows gets the most frequent language and
its share of labelled n-grams. Rows without a text or language teach nothing; repeated rows count as often as they
stand. Ties go to the language first in order. Without any labelled row every text is `und`. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import Scratch, held_out, mix64

SIZES, PROBES, SLOTS, CAPACITY = (3, 4), 4, 1 << 20, 30_000
DOMINANCE = 0.2  # an n-gram counts for a language that uses it at least this often, relative to its heaviest user
HELD_GRAMS, PIECE_CHARS = 1 << 21, 1 << 19
_PLACE = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, max(SIZES) + PROBES, dtype=np.uint64) | np.uint64(1)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of all texts, and the number of keys before each text."""
    letters = _letters()
    codes = np.frombuffer("".join(f"\0{t.lower()}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    known = letters[codes]
    # One space for a stretch without letters; texts meet at such a stretch, which belongs to the later one.
    keep = known.copy()
    keep[1:] |= known[:-1]
    keep[0] = True
    codes, owner, known = np.where(known, codes, np.uint32(32))[keep].astype(np.uint64), owner[keep], known[keep]
    keys, owners = [], []
    for size in SIZES:
        n = max(len(codes) - size + 1, 0)
        value = np.full(n, size, np.uint64)
        for k in range(size):
            value += codes[k : k + n] * _PLACE[k]
        # The middle must not be a space: no n-gram spans two words, so none spans two texts.
        inside = known[1 : 1 + n].copy()
        for k in range(2, size - 1):
            inside &= known[k : k + n]
        keys.append(mix64(value[inside]))
        owners.append(owner[1 : 1 + n][inside])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.searchsorted(owners[order], np.arange(len(texts) + 1))


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive whole texts of some PIECE_CHARS characters; null is the empty text."""
    first, size, texts = 0, 0, []
    for k, value in enumerate(column):
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= PIECE_CHARS:
            yield first, texts
            first, size, texts = k + 1, 0, []
    if texts:
        yield first, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), combined over a task as far as HELD_GRAMS allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    def emit(lang: str) -> pa.RecordBatch:
        keys, n = combined(held.pop(lang))
        return pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, texts in _pieces(batch.column(1)):
            keys, ends = grams(texts)
            own = langs[first : first + len(texts)]
            for lang in set(own):
                mine = [keys[ends[k] : ends[k + 1]] for k, name in enumerate(own) if name == lang]
                found, n = np.unique(np.concatenate(mine), return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((found, n))
                if sum(len(p[0]) for p in parts) > HELD_GRAMS:
                    held[lang] = [combined(parts)]
                    if len(held[lang][0][0]) > HELD_GRAMS // 2:
                        yield emit(lang)
    for lang in list(held):
        yield emit(lang)


@dataclass(frozen=True)
class LanguageFilter:
    """Languages in order, slots x planes masks of 64 languages each, chance of a false hit and share per language."""

    languages: list
    masks: np.ndarray
    chance: np.ndarray
    share: np.ndarray

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        keys, ends = grams(texts)
        rows, names = len(texts), len(self.languages)
        if not names:
            return ["und"] * rows, [0.0] * rows
        hits = np.full((len(keys), self.masks.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for k in range(PROBES):
            hits &= self.masks[(mix64(keys * _PLACE[max(SIZES) + k]) % np.uint64(len(self.masks))).astype(np.int64)]
        n = np.diff(ends)
        counts = np.empty((rows, names))
        total = np.zeros(len(keys) + 1, np.int64)
        for k in range(names):
            np.cumsum((hits[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int64), out=total[1:])
            counts[:, k] = total[ends[1:]] - total[ends[:-1]]
        counts = np.maximum((counts - n[:, None] * self.chance) / (1 - self.chance), 0)
        best, whole = counts.argmax(axis=1), counts.sum(axis=1)
        unknown = whole <= 1e-9
        best[unknown] = int(self.share.argmax())
        score = np.where(unknown, self.share.max(), counts[np.arange(rows), best] / np.where(unknown, 1, whole))
        none = n == 0
        return [("und" if x else self.languages[b]) for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score).tolist()


def learn(examples: DataFrame, capacity: int = CAPACITY, slots: int = SLOTS) -> LanguageFilter:
    """Filter from rows (lang, text); its size is bounded by `slots`, not by the data."""
    rows = examples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counted = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Counts stand in the shuffle once more below; a written table keeps the texts from being read again.
    counted = Scratch(examples.sparkSession, "language").keep(counted, "grams")
    step = F.floor(F.log2("n") * 4).cast("int")
    shape = counted.groupBy("lang", step.alias("step")).agg(F.count("*").alias("grams"), F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in shape})
    if not languages:
        return LanguageFilter([], np.zeros((1, 1), np.uint64), np.zeros(0), np.zeros(0))
    totals = {lang: sum(r["n"] for r in shape if r["lang"] == lang) for lang in languages}
    least = {}
    for lang in languages:
        room, reached = capacity, math.inf
        for r in sorted((r for r in shape if r["lang"] == lang), key=lambda r: -r["step"]):
            if r["grams"] > room and reached < math.inf:
                break
            room, reached = room - r["grams"], r["step"]
        least[lang] = reached
    settings = examples.sparkSession.createDataFrame(
        [(lang, k, totals[lang], least[lang]) for k, lang in enumerate(languages)], "lang string, bit int, total long, least int"
    )
    rated = counted.join(F.broadcast(settings), "lang").withColumn("rate", F.col("n") / F.col("total"))
    heaviest = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate", (step >= F.col("least")).alias("frequent"))).alias("users"))
    known = heaviest.select("gram", "top", F.explode("users").alias("u")).where(F.col("u.frequent") & (F.col("u.rate") >= DOMINANCE * F.col("top")))
    planes = (len(languages) + 63) // 64

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bit = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            mask = np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64)).view(np.int64)
            for k in range(PROBES):
                slot = (mix64(keys * _PLACE[max(SIZES) + k]) % np.uint64(slots)).astype(np.int64)
                yield pa.record_batch([pa.array(slot), pa.array((bit // 64).astype(np.int32)), pa.array(mask)], names=["slot", "plane", "mask"])

    placed = known.select("gram", "u.bit").mapInArrow(slots_of, "slot long, plane int, mask long")
    filled = placed.groupBy("slot", "plane").agg(F.bit_or("mask").alias("mask"))
    table = filled.toArrow()
    masks = np.zeros((slots, planes), np.uint64)
    masks[table.column("slot").to_numpy(), table.column("plane").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    full = np.array([float((masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) for k in range(len(languages))])
    share = np.array([totals[lang] for lang in languages], float)
    return LanguageFilter(languages, masks, full**PROBES, share / share.sum())


def identify(docs: DataFrame, model: LanguageFilter, *carried: Column) -> DataFrame:
    """(doc_id, carried columns, lang_pred, score) for every row of (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select("doc_id", *carried, docs["text"].cast("string").alias("text"))
    fields = [f for f in chosen.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch.column(batch.num_columns - 1)):
                names, scores = shipped.value.decide(texts)
                part = batch.slice(first, len(texts))
                yield pa.record_batch([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return chosen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept_back = held_out(F.col("doc_id"), 3, 1)
    return identify(docs, learn(docs.where(~kept_back)), kept_back.alias("held_out"))
