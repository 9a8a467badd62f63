"""Main text of pages by a tree-structured graphical model.

The blocks of a page and the runs of text in them are the nodes of a tree. A node is content, other, or a block that holds both;
a run cannot be the last. Potentials of single nodes are sums of weights of what can be seen of a block or run (tag, words of its
names, length, share of links, sentence marks, but no words, so no language is preferred); potentials of parent and child tie a run to its block and a block to what it
stands in, so that a short line in an article stays and a long one among reader comments goes. One pass up the tree and one
down give the marginals of every node; runs whose marginal of content is one half or more are the text. Marginals are exact
where no block has more than FULL_CHILDREN children. The messages of more children count as those of so many, by equal
parts, since copies of one weak hint are not evidence without end: an article of a thousand one-word lines stays one.

Weights are fitted to labelled pages by gradient steps on the likelihood of the labels, whose gradient is what was seen minus what the
marginals expect. The set learnt from is that of `layouts`, TRAINING_PAGES large, or any pages marked in the same way. Pages of
a chunk are passed level by level together. The rest is one map over the table; only weights are sent to tasks.

Defined results: null and empty html, and pages without content, give the empty text. White space is what Unicode calls
so, no-break spaces included; a line break inside a block is white space. A page is read whole whatever its length, and
chunks are a mebibyte or one page. Repeated rows and null ids or addresses stay as they are; extra columns are not
read. Ties, a marginal of exactly one half, are content.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import utf8_pieces
from sessionloom.llm.dom import Page
from sessionloom.llm.layouts import labelled_pages

OTHER, CONTENT, BOTH = range(3)
STATES, NEVER = 3, -40.0
NAMED, PLAIN, RUN = range(3)
KINDS = 3
FULL_CHILDREN = 6
TRAINING_PAGES, STEPS, RATE, DECAY = 420, 150, 0.15, 5e-4
_PLAIN = frozenset("p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tfoot tr td th caption figure figcaption div center".split())
_ENDS, _COMMAS = frozenset(".!?…。！？؟।"), frozenset(",،、，;；:")


def _size(n: int) -> int:
    return n.bit_length() if n < 256 else 9 if n < 2048 else 10


def _share(part: int, whole: int) -> int:
    return 0 if not part else 1 + min(3, 4 * part // max(whole, 1))


def features(page: Page) -> list[list[str]]:
    """What can be seen of each node."""
    n = len(page.parent)
    chars, links, runs = [len(t) for t in page.text], list(page.linked), [int(not t) for t in page.tag]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        runs[p] += runs[i]
    found = []
    for i in range(n):
        tag, share = page.tag[i], _share(links[i], chars[i])
        if tag:
            held = ["block", f"tag {tag}", f"block size {_size(chars[i])}", f"block links {share}", f"block runs {min(runs[i], 4)}"]
            found.append(held + [f"name {w}" for w in page.words[i]])
            continue
        text, above = page.text[i], page.tag[page.parent[i]]
        marks = sum(c in _ENDS for c in text[-400:])
        found.append(
            ["run", f"size {_size(len(text))}", f"links {share}", f"in {above}", f"links {share} in {above}", f"marks {min(marks, 3)}", f"commas {min(sum(c in _COMMAS for c in text[:400]), 3)}",
             f"ends {text[-1] in _ENDS}"]
        )
    return found


def kinds(page: Page) -> list[int]:
    """How a node hangs on its parent: a block that has names or a telling tag, a plain block, or a run."""
    return [RUN if not t else PLAIN if t in _PLAIN and not w else NAMED for t, w in zip(page.tag, page.words, strict=True)]


class Forest:
    """Trees of several pages, their nodes by level, for passing messages in both directions."""

    def __init__(self, parents: Iterable[list[int]]) -> None:
        all_, first = [], 0
        for p in parents:
            own = np.asarray(p, np.int64)
            all_.append(np.where(own >= 0, own + first, -1))
            first += len(own)
        self.parent = np.concatenate(all_) if all_ else np.zeros(0, np.int64)
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):  # parents stand before their children
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        children = np.bincount(self.parent[self.parent >= 0], minlength=len(self.parent))
        self.part = np.minimum(1.0, FULL_CHILDREN / np.maximum(children[self.parent], 1))  # of a node's message to its parent

    def marginals(self, single: np.ndarray, pair: np.ndarray, kind: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(node x state marginals, kind x parent state x child state expected counts) for log potentials.

        `pair[kind[i]]` ties node i to its parent."""
        up, sent = single.copy(), np.zeros_like(single)
        for rows in reversed(self.levels):
            message = _log_sum(up[rows][:, None, :] + pair[kind[rows]]) * self.part[rows][:, None]
            sent[rows] = message
            above = self.parent[rows]
            starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            up[above[starts]] += np.add.reduceat(message, starts, axis=0)
        down, expected = np.zeros_like(single), np.zeros_like(pair)
        for rows in self.levels:
            above = self.parent[rows]
            joint = (up[above] + down[above] - sent[rows])[:, :, None] + pair[kind[rows]]
            down[rows] = _log_sum(np.swapaxes(joint, 1, 2))
            if pairs:
                joint = joint + up[rows][:, None, :]
                weight = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                weight /= weight.sum(axis=(1, 2), keepdims=True)
                for k in range(len(pair)):
                    expected[k] += weight[kind[rows] == k].sum(axis=0)
        both = up + down
        weight = np.exp(both - both.max(axis=1, keepdims=True))
        return weight / weight.sum(axis=1, keepdims=True), expected if pairs else None


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(axis=-1, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=-1)) + top[..., 0]


def _flat(found: list[list[str]], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first of each node); unknown features are left out, each node has at least one."""
    ids, firsts = [], []
    for held in found:
        firsts.append(len(ids))
        ids += [number[f] for f in held if f in number]
    return np.array(ids, np.int64), np.array(firsts, np.int64)


@dataclass
class Model:
    number: dict[str, int]
    weights: np.ndarray  # feature x state
    pair: np.ndarray  # kind x parent state x child state

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Marginal of content of every node, for each page."""
        ids, firsts = _flat([f for p in pages for f in features(p)], self.number)
        kind = np.array([k for p in pages for k in kinds(p)], np.int64)
        single = np.add.reduceat(self.weights[ids], firsts, axis=0)
        single[kind == RUN, BOTH] = NEVER
        found, _ = Forest(p.parent for p in pages).marginals(single, self.pair, kind)
        cuts = np.cumsum([len(p.parent) for p in pages])[:-1]
        return np.split(found[:, CONTENT], cuts)

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        found = self.content(pages) if pages else []
        return ["\n\n".join(t for t, c in zip(p.text, own.tolist(), strict=True) if t and c >= 0.5) for p, own in zip(pages, found, strict=True)]


def states(page: Page) -> list[int]:
    """Labels of a marked page: runs and blocks inherit the nearest mark; a block without the mark of content that holds content is both."""
    n = len(page.parent)
    marked = [False] * n
    for i in range(n):
        inherited = marked[page.parent[i]] if i else False
        marked[i] = page.label[i] == "content" if page.label[i] else inherited
    holds = [m and not t for m, t in zip(marked, page.tag, strict=True)]
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    return [CONTENT if m else BOTH if h and t else OTHER for m, h, t in zip(marked, holds, page.tag, strict=True)]


def learn(pages: Iterable[str], steps: int = STEPS) -> Model:
    """Fit to marked pages; features seen on one page only are left out but for those every page has."""
    read = [Page(p) for p in pages]
    seen: dict[str, int] = {}
    held = [features(p) for p in read]
    for page in held:
        for f in {f for node in page for f in node}:
            seen[f] = seen.get(f, 0) + 1
    number = {f: k for k, f in enumerate(sorted(f for f, c in seen.items() if c >= 3 or f in ("block", "run")))}
    ids, firsts = _flat([f for page in held for f in page], number)
    owner = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(ids))))
    kind = np.array([k for p in read for k in kinds(p)], np.int64)
    truth = np.eye(STATES)[[s for p in read for s in states(p)]]
    forest = Forest(p.parent for p in read)
    child = np.concatenate(forest.levels)
    wanted = np.zeros((KINDS, STATES, STATES))
    np.add.at(wanted, (kind[child], truth[forest.parent[child]].argmax(axis=1), truth[child].argmax(axis=1)), 1)

    weights, pair = np.zeros((len(number), STATES)), np.zeros((KINDS, STATES, STATES))
    first = [np.zeros_like(weights), np.zeros_like(pair)]
    second = [np.zeros_like(weights), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        single = np.add.reduceat(weights[ids], firsts, axis=0)
        single[kind == RUN, BOTH] = NEVER
        found, expected = forest.marginals(single, pair, kind, pairs=True)
        away = (truth - found)[owner]
        slope = np.stack([np.bincount(ids, away[:, s], len(number)) for s in range(STATES)], axis=1)
        for k, (value, grade) in enumerate(((weights, slope / len(read)), (pair, (wanted - expected) / len(read)))):
            grade = grade - DECAY * value
            first[k] = 0.9 * first[k] + 0.1 * grade
            second[k] = 0.99 * second[k] + 0.01 * grade**2
            value += RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(number, weights, pair)


@lru_cache(1)
def default_model() -> Model:
    return learn(labelled_pages(TRAINING_PAGES))


def _extract(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, offsets in utf8_pieces(batch.column(2)):
            data, ends = raw.tobytes(), offsets.tolist()
            texts = model.texts([data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)])
            yield pa.record_batch(
                [batch.column(0)[first:last], batch.column(1)[first:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def main_texts(pages: DataFrame, page_id: Column, url: Column, html: Column, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or default_model()
    held = pages.select(page_id.cast("long").alias("page_id"), url.cast("string").alias("url"), html.cast("string").alias("html"))
    return held.mapInArrow(lambda it: _extract(it, model), "page_id long, url string, text string, n_chars long")


def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{folder}/pages.parquet"), F.col("page_id"), F.col("url"), F.col("html"))
