"""Toxicity categories by a classifier chain.

The categories are predicted one after the other by linear models over the words of a text: *insult* and *contempt*,
whose labels are the toxic rows with a word of the category's seeds, then *toxic*, the given label. The probabilities
of the earlier categories are inputs of the later models; in training they are out-of-fold predictions, so that a later
model learns from what it will see. The inputs are all words of the sampled rows and the beginnings of the longer ones,
hashed into a fixed space. None is left out: a word's weight is shrunk the less, the clearer its share of the category's
rows departs from that of the rest.

Training reads a bounded sample of labelled rows; its words reach the driver as bucket numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import U64, mixed, passes, remainder, spans_hash, utf8
from ripplecart.llm.decontaminate import _LOWER, _WORD, words
from ripplecart.llm.quality import labelled

#: Labelled rows that training reads at most (about), folds of the chain's inputs, bits of a bucket number, bytes of a word's beginning.
SAMPLE, FOLDS, BITS, BEGINNING = 8_000, 5, 20, 6
RIDGE = 3.0
SEEDS = {
    "insult": "idiot moron stupid loser clown fool dumb jerk liar creep",
    "contempt": "worthless pathetic disgusting trash scum garbage vile filthy useless vermin",
}
CATEGORIES = [*SEEDS, "toxic"]


def _ids(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def _counted(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each text: text number, key, count."""
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    start = np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]))) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(start)
    return text[at], key[at], np.diff(np.append(at, len(key)))


def beginnings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the first BEGINNING bytes of the longer words of all texts, and the text that each stands in."""
    data, at = utf8(col)
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    data = np.insert(_LOWER[data], at[1:], 0)  # as in `words`
    at = at + np.arange(len(at))
    inside = np.concatenate(([False], _WORD[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    starts = starts[ends - starts > BEGINNING]
    return spans_hash(data, starts, starts + BEGINNING) & ~U64(1), np.searchsorted(at, starts, "right") - 1


def distinct_buckets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text's words and beginnings: text number, bucket, count."""
    (word, text), (begin, text_of) = words(*utf8(col)), beginnings(col)
    bucket = mixed(np.concatenate((word, begin))) >> U64(64 - BITS)
    return _counted(np.concatenate((text, text_of)), bucket.astype(np.uint32))


@dataclass
class Rows:
    """Sparse rows: the row, column and value of each cell."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int
    width: int

    @classmethod
    def of(cls, x: Rows | np.ndarray) -> Rows:
        if isinstance(x, Rows):
            return x
        row, column = np.nonzero(x)
        return cls(row, column, x[row, column], *x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.width)


@dataclass
class Chain:
    buckets: np.ndarray  # that training has seen, sorted
    weights: list[np.ndarray]  # of each category: buckets, earlier categories, intercept
    threshold: float

    def inputs(self, text: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> Rows:
        at = np.minimum(np.searchsorted(self.buckets, bucket), max(len(self.buckets) - 1, 0))
        hit = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        return Rows(text[hit], at[hit], 1 + np.log(count[hit]), n, len(self.buckets))

    def predict(self, x: Rows | np.ndarray) -> np.ndarray:
        x = Rows.of(x)
        p = np.zeros((x.n, 0))
        for w in self.weights:
            p = np.hstack([p, sigmoid(x.times(w[: x.width]) + np.hstack([p, np.ones((x.n, 1))]) @ w[x.width :])[:, None]])
        return p


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def reach(x: Rows, y: np.ndarray, on: np.ndarray) -> np.ndarray:
    """How far each column's weight may go: the log ratio of its shares of both kinds of rows times that ratio over its error.

    Scaled to a mean square of 1; 0 for a column that no row has.
    """
    with_, without = (np.bincount(x.column, (on * (y == v))[x.row], x.width) for v in (1, 0))
    ratio = np.log((with_ + 0.5) / ((on * y).sum() + 1)) - np.log((without + 0.5) / ((on * (1 - y)).sum() + 1))
    out = np.where(with_ + without > 0, ratio * np.abs(ratio) / np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5)), 0)
    return out / max(np.sqrt((out**2).sum() / max((out != 0).sum(), 1)), 1e-12)


def logistic(x: Rows, more: np.ndarray, y: np.ndarray, on: np.ndarray, ridge: float = RIDGE, steps: int = 8, turns: int = 12) -> np.ndarray:
    """Ridge logistic regression on the rows that are `on`, by Newton steps solved by conjugate gradients.

    The weights of x are shrunk against their `reach`; the last column of `more` is the intercept, which is not shrunk.
    """
    scale, m = reach(x, y, on), x.width
    keep = np.concatenate([np.full(m, ridge), np.ones(more.shape[1])])
    keep[-1] = 1e-3
    forth = lambda w: x.times(scale * w[:m]) + more @ w[m:]
    back = lambda r: np.concatenate([scale * x.back(r), more.T @ r])
    w = np.zeros(m + more.shape[1])
    w[-1] = np.log(((on * y).sum() + 0.5) / ((on * (1 - y)).sum() + 0.5))
    z = forth(w)
    loss = lambda z, w: (on * (np.logaddexp(0, z) - y * z)).sum() + (keep * w * w).sum() / 2
    first, now = None, loss(z, w)
    for _ in range(steps):
        p = sigmoid(z)
        d = on * p * (1 - p)
        g = back(on * (p - y)) + keep * w
        size = np.sqrt(g @ g)
        first = first or size
        if size <= 1e-3 * first:
            break
        near = keep + np.concatenate([scale**2 * np.bincount(x.column, x.value**2 * d[x.row], m), (more**2).T @ d])
        step, rest = np.zeros_like(w), -g
        q = rest / near
        way, left = q.copy(), rest @ q
        enough = 1e-4 * left
        for _ in range(turns):
            h = back(d * forth(way)) + keep * way
            step += left / (way @ h) * way
            rest = rest - left / (way @ h) * h
            q = rest / near
            left, before = rest @ q, left
            if left <= enough:
                break
            way = q + left / before * way
        dz = forth(step)
        for _ in range(8):
            if (then := loss(z + dz, w + step)) <= now:
                z, w, now = z + dz, w + step, then
                break
            step, dz = step / 2, dz / 2
        else:
            break
    w[:m] *= scale
    return w


def fit(buckets: np.ndarray, x: Rows | np.ndarray, targets: np.ndarray, folds: int = FOLDS) -> Chain:
    """Chain over inputs x (rows x buckets) and targets (rows x categories)."""
    x = Rows.of(x)
    p, weights = np.zeros((x.n, 0)), []
    fold = np.arange(x.n) % folds
    for k in range(targets.shape[1]):
        more, y = np.hstack([p, np.ones((x.n, 1))]), targets[:, k]
        out = np.zeros(x.n)
        for f in range(folds):
            if (fold == f).any() and (fold != f).any():
                w = logistic(x, more, y, (fold != f).astype(float))
                out[fold == f] = sigmoid(x.times(w[: x.width]) + more @ w[x.width :])[fold == f]
        weights.append(logistic(x, more, y, np.ones(x.n)).astype(np.float32))
        p = np.hstack([p, out[:, None]])
    last, y = p[:, -1], targets[:, -1]
    tries = np.linspace(0.01, 0.99, 99)
    f1 = [2 * (y * (last >= t)).sum() / max(1, y.sum() + (last >= t).sum()) for t in tries]
    return Chain(buckets, weights, float(tries[int(np.argmax(f1))]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    seeds = [_ids(x) for x in SEEDS.values()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            word, text_of = words(*utf8(batch.column("text")))
            said = [np.bincount(text_of[np.isin(word, ids)], minlength=batch.num_rows) > 0 for ids in seeds]
            text, bucket, count = distinct_buckets(batch.column("text"))
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            cells = [(bucket[a:b].tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            said = pa.array(sum(s.astype(np.int32) << k for k, s in enumerate(said)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), said, pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["doc_id", "y", "said", "bucket", "count"])

    got = labelled(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, "toxic", sample)
    got = got.mapInArrow(rows, "doc_id long, y int, said int, bucket binary, count binary").toArrow().to_pydict()
    order = sorted(range(len(got["y"])), key=lambda i: (got["doc_id"][i], got["bucket"][i]))  # whatever order the rows came in
    y, said = (np.array([got[c][i] for i in order], kind) for c, kind in (("y", float), ("said", int)))
    bucket, count = (np.frombuffer(b"".join(got[c][i] for i in order), kind) for c, kind in (("bucket", np.uint32), ("count", np.int32)))
    text = np.repeat(np.arange(len(order), dtype=np.int32), [len(got["bucket"][i]) // 4 for i in order])
    del got
    if not len(bucket) or len(np.unique(y)) < 2:
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Chain(np.zeros(0, np.uint32), [np.r_[np.zeros(k), np.log(rate / (1 - rate))] for k in range(len(CATEGORIES))], 0.5)
    seen = np.unique(bucket)
    x = Chain(seen, [], 0.5).inputs(text, bucket, count, len(y))
    return fit(seen, x, np.stack([*(y * (said >> k & 1) for k in range(len(SEEDS))), y], 1))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, p_insult, p_contempt, score, predicted, toxic for every row of `docs`.

    `score` is the chain's last probability, of the given label; `predicted` and `toxic` say whether it reaches the
    threshold with the best F1 out of fold. A null text counts as empty and, like any text without a known word, gets
    the intercept's score. Learned from labels outside the held-out fifth of the ids; without labels of both
    kinds every score is the labels' rate.
    """
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            p = chain.value.predict(chain.value.inputs(*distinct_buckets(batch.column("text")), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= chain.value.threshold)], names=["doc_id", "p_insult", "p_contempt", "score", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(score, "doc_id long, p_insult double, p_contempt double, score double, toxic boolean")
    return out.select("*", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxic").cast("int").alias("predicted"))
