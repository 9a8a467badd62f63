"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text. Its covariance is shrunk towards the pooled one
and that towards a multiple of the identity, so it always has a Cholesky factor. A score is the logistic function
of the difference of the two log densities plus the log ratio of class sizes; the squared Mahalanobis distances use
the inverse factors, which are computed once and shipped with the model.

Nulls and empty texts have the statistics of a text without characters and get a score like any other. Rows without
a label, or with one that is neither 0 nor 1, teach nothing; repeated rows count as often as they stand. Without a
row of both classes the score is the share of label 1 (0.5 without labels). Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import held_out, sums_between, utf8_pieces

STATISTICS = (
    "length", "word_length", "upper", "digit", "marks", "stops", "distinct_words", "same_as_last", "top_word",
    "distinct_lines", "line_length", "long_words",
)
_SPACE, _UPPER, _DIGIT, _MARK, _STOP, _BREAK = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = _SPACE
    table[10] |= _BREAK
    table[65:91] = _UPPER
    table[48:58] = _DIGIT
    for code in range(33, 127):
        if not chr(code).isalnum() and chr(code) not in ".,;:'\"-?":
            table[code] = _MARK
    for mark in ".?":
        table[ord(mark)] = _STOP
    return table


_CLASSES = _classes()
_CODES = np.random.Generator(np.random.PCG64(71)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _span_keys(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each stretch; order inside a stretch counts through the distance from its start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weight = (inside.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _STEP
    weight ^= weight >> np.uint64(29)
    values = _CODES[raw[np.repeat(starts, lengths) + inside]] * weight
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths] + lengths.astype(np.uint64)


def _distinct(owner: np.ndarray, keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the largest count of one key, by owner."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(o)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, o[at], counts)
    return np.bincount(o[at], minlength=rows), most


def _piece_statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    kind = _CLASSES[raw]
    chars = sums_between(raw & 0xC0 != 0x80, offsets)
    upper, digit, marks, stops = (sums_between(kind & bit != 0, offsets) for bit in (_UPPER, _DIGIT, _MARK, _STOP))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    owner_of = lambda at: np.searchsorted(offsets, at, "right") - 1

    def stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    w0, w1 = stretches(kind & _SPACE == 0)
    owner = owner_of(w0)
    words = np.bincount(owner, minlength=rows)
    keys = _span_keys(raw, w0, w1)
    distinct, most = _distinct(owner, keys, rows)
    same = np.zeros(len(owner), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[same], minlength=rows)
    long_words = np.bincount(owner[(w1 - w0) > 24], minlength=rows)
    l0, l1 = stretches(kind & _BREAK == 0)
    line_owner = owner_of(l0)
    lines = np.bincount(line_owner, minlength=rows)
    distinct_lines, _ = _distinct(line_owner, _span_keys(raw, l0, l1), rows)

    n, w, ln = chars + 50, words + 10, lines + 3  # shares of very short texts lean towards zero
    odds = lambda part, whole: np.log((part + 0.5) / (whole - np.minimum(part, whole) + 0.5))
    share = lambda part, whole: np.sqrt(part / whole)
    return np.stack(
        [
            np.log1p(chars), np.log1p(chars / np.maximum(words, 1)), share(upper, n), share(digit, n), share(marks, n), share(stops, n),
            np.log(distinct + 10) / np.log(w), share(repeats, w), share(np.maximum(most - 2, 0), w),
            share(lines - distinct_lines, ln), np.log1p(chars / np.maximum(lines, 1)), odds(long_words, w) - odds(np.zeros_like(w), w),
        ],
        axis=1,
    ).astype(np.float64)


def text_statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; null counts as the empty text."""
    pieces = [_piece_statistics(raw, offsets) for _, _, raw, offsets in utf8_pieces(texts)]
    return np.concatenate(pieces) if pieces else np.zeros((0, len(STATISTICS)))


def statistics_column(text: Column) -> Column:
    """The statistics of a text as array<double>."""

    @F.arrow_udf("array<double>")
    def statistics(texts: pa.Array) -> pa.Array:
        found = text_statistics(texts)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(STATISTICS), dtype=np.int32), pa.array(found.ravel()))

    return statistics(text)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes."""

    prior: float = 0.0
    means: list = field(default_factory=list)
    inverse_factors: list = field(default_factory=list)
    log_determinants: list = field(default_factory=list)

    def log_odds(self, values: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(values), self.prior)
        density = []
        for mean, inverse, log_det in zip(self.means, self.inverse_factors, self.log_determinants, strict=True):
            z = (values - mean) @ inverse.T
            density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + log_det))
        return self.prior + density[1] - density[0]


def fit(examples: DataFrame, label: str = "quality", shrink_pooled: float = 0.1, shrink_identity: float = 0.01) -> Discriminant:
    """Fit from rows (features array<double>, label 0/1). Spark sums the moments of all rows; only they reach the driver."""
    width = len(STATISTICS)
    value = [F.col("features")[i] for i in range(width)]
    moments = [F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(value))]
    moments += [F.sum(value[i] * value[j]).alias(f"p{i}_{j}") for i in range(width) for j in range(i, width)]
    rows = {r["label"]: r for r in examples.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("label")).agg(*moments).collect()}
    if len(rows) < 2:
        return Discriminant(prior={0: -20.0, 1: 20.0}[next(iter(rows))] if rows else 0.0)
    n = {k: r["n"] for k, r in rows.items()}
    means = {k: np.array([r[f"s{i}"] for i in range(width)]) / n[k] for k, r in rows.items()}
    scatter = {}
    for k, r in rows.items():
        second = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)])
        scatter[k] = second - n[k] * np.outer(means[k], means[k])
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    scale = np.maximum(np.diag(pooled), 1e-9)  # the identity in units of each statistic
    factors, determinants = [], []
    for k in (0, 1):
        own = (1 - shrink_pooled) * scatter[k] / n[k] + shrink_pooled * pooled
        own = (1 - shrink_identity) * own + shrink_identity * np.diag(scale)
        factor = np.linalg.cholesky(own + np.diag(np.full(width, 1e-12)))
        factors.append(np.linalg.inv(factor))
        determinants.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(float(np.log(n[1] / n[0])), [means[0], means[1]], factors, determinants)


def score_column(model: Discriminant, text: Column) -> Column:
    """Score of a text, 0 to 1; higher means that label 1 is likelier."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        odds = np.clip(model.log_odds(text_statistics(texts)), -40, 40)
        return pa.array(1 / (1 + np.exp(-odds)))

    return score(text)


def learn(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the labelled documents that are not held out. Features are taken before the join, so no text is shuffled."""
    seen = docs.where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", statistics_column(F.col("text")).alias("features"))
    return fit(seen.join(labels.select("doc_id", "quality"), "doc_id"))


def op10_quality(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return docs.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), score_column(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
