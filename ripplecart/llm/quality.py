"""Quality of a text: histogram gradient-boosted trees over document statistics.

Executors turn whole texts into a fixed row of statistics. The trees are grown in numpy on the driver from
a bounded sample of labelled rows: statistics are binned once, a node's split comes from the gradient and hessian
histograms of its rows. The finished trees are flattened into arrays (feature, bin threshold, leaf value), a
level of all trees at a time, and scoring walks all rows down all trees by array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import hash_share, passes, remainder, runs, spans_hash, utf8

#: Labelled rows that training reads at most (about: a share of them drawn by hash).
SAMPLE = 20_000
THRESHOLD = 0.3

#: Byte classes: lower case, upper case, digit, space, line end, full stop and comma, each sign that junk is full of, other
#: ASCII, and bytes of characters beyond ASCII.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,", b"!", b"?", b"#", b"$", b"%", b"&", b"*", b"|", b"@/:_-=", b"\"'()[]{}<>"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
_CLASS[0x80:] = len(_CLASSES) + 1
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
N_CLASSES = len(_CLASSES) + 2
N_FEATURES = N_CLASSES + 8


def _distinct(text: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different keys of each text, and the count of its commonest key."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, text[start], np.diff(np.append(start, len(key))))
    return np.bincount(text[start], minlength=n), most


def statistics(col: pa.Array) -> np.ndarray:
    """One row of N_FEATURES statistics per text; an empty or null text has zeros."""
    data, at = utf8(col)
    n = len(at) - 1
    size = np.diff(at)
    text = np.repeat(np.arange(n), size)
    counts = np.bincount(text * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    one = np.maximum(size, 1)[:, None]
    out = [counts / one]
    data = np.insert(data, at[1:], 10)
    at = at + np.arange(n + 1)
    for gap in (data <= 0x20, data == 10):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ~gap, [False]))))
        starts, ends = edge[::2], edge[1::2]
        text = np.searchsorted(at, starts, "right") - 1
        many = np.bincount(text, minlength=n)
        different, most = _distinct(text, spans_hash(data, starts, ends), n)
        length = np.bincount(text, ends - starts, minlength=n)
        out += [x[:, None] for x in (different / np.maximum(many, 1), most / np.maximum(many, 1), length / np.maximum(many, 1), np.log1p(many))]
    return np.hstack(out)


@dataclass
class Trees:
    edges: list[np.ndarray]  # bin borders of each statistic
    feature: np.ndarray  # trees x inner nodes, in heap order
    cut: np.ndarray  # go right when the bin is above
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        bins = binned(x, self.edges)
        total = np.full(len(x), self.base)
        row = np.arange(len(x))[:, None]
        tree = np.arange(len(self.feature))[None, :]
        if len(self.feature):
            node = np.zeros((len(x), len(self.feature)), np.int64)
            inner = self.feature.shape[1]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (bins[row, self.feature[tree, node]] > self.cut[tree, node])
            total = total + self.leaf[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-total))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.uint8)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Boosted trees on the logistic loss; without both labels in y, the trees are none and the score is the share of 1."""
    p = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    out = Trees(edges, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth)), float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return out
    b = binned(x, edges).astype(np.int64)
    raw = np.full(len(y), out.base)
    made = []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            best = np.full(wide, 1e-6)
            for j in range(x.shape[1]):
                slot = local * bins + b[:, j]
                G = np.cumsum(np.bincount(slot, g, wide * bins).reshape(wide, bins), 1)
                H = np.cumsum(np.bincount(slot, h, wide * bins).reshape(wide, bins), 1)
                gain = G**2 / (H + ridge) + (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + ridge) - G[:, -1:] ** 2 / (H[:, -1:] + ridge)
                gain[(H < 2) | (H[:, -1:] - H < 2)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(wide), at] > best
                best = np.where(better, gain[np.arange(wide), at], best)
                feature[first : first + wide][better], cut[first : first + wide][better] = j, at[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        local = node - (2**depth - 1)
        leaf = -rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        raw += leaf[local]
        made.append((feature, cut, leaf))
    out.feature, out.cut, out.leaf = (np.array(z) for z in zip(*made, strict=True))
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """text, y and y_rest of about `sample` labelled rows outside the held-out fifth, drawn by hash of the id.

    The drawn labels are at most a few times `sample` rows of two numbers, so they are broadcast and texts stay put.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)).select("doc_id", F.col(label).cast("int").alias("y"))
    n = known.count()
    drawn = known.where(hash_share("doc_id") < sample / max(n, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    got = labelled(docs, labels, "quality", sample).mapInArrow(rows, "y int, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist())).reshape(-1, N_FEATURES)
    y = np.array(got["y"], float)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return grow(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    A null text counts as empty; an empty one has statistics like any other. Only `labels` with a quality and an
    id outside the held-out fifth are learned from; several labels of one id count as their largest. Without labels
    every score is 0.5, with one class alone about 0 or 1.
    """
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.value.score(statistics(batch.column("text"))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
