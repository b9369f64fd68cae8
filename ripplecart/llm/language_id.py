"""Language of a text: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean embedding of its hashed byte n-grams, lower-cased, with everything in ASCII that is no
letter as a word break. Embeddings and softmax are trained together by stochastic gradient descent in numpy on the driver,
from n-gram counts that the executors make of a sample: about `per_language` documents of each language, less where the
languages are so many that `budget` documents do not give as many, chosen by a hash of their id, and two short cuts of each from anywhere in
the text, so that short texts are learned too. A fifth of the sampled documents, with their cuts, trains nothing and calibrates the
temperature of the scores and the two limits of rejection: the confidence between the learned languages, and how usual a text's
n-grams are at all. The second is the mean log frequency of its n-grams in the sample, held against what the
calibration texts show at that length; a text in a language or script that was not learned falls far below it, however sure
the softmax is that it resembles one language more than the others.

For prediction embedding and softmax fold into one table of logits per n-gram, so a text costs table look-ups alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import column, hash_share, mixed, offsets, passes, remainder, utf8

BITS = 14
SIZES = (2, 3, 4)
#: Sampled documents of a language, of all together (about), and of a language at least.
PER_LANGUAGE, BUDGET, LEAST = 1_000, 80_000, 20
UNKNOWN = "und"

_BREAK = np.arange(256, dtype=np.uint8)
_BREAK[:0x41] = _BREAK[0x5B:0x61] = _BREAK[0x7B:0x80] = 0x20


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each size; the last few bytes start none."""
    x = _BREAK[data].astype(np.uint32)
    out = []
    for n in SIZES:
        code = np.full(max(len(x) - n + 1, 0), n, np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) ^ x[i : len(x) - n + 1 + i]
        out.append((code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.binary_join_element_wise("", pc.fill_null(col, ""), "", " "))  # a word break on either side


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket, temperature included
    bias: np.ndarray
    least: float  # scores below are rejected
    usual: np.ndarray  # log frequency of each bucket
    spread: tuple[float, float, float]  # of its mean over a text: the mean, variance between texts, variance of one n-gram
    limit: float  # texts further below the mean, in deviations, are rejected

    def logits(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and how many deviations its n-grams are more usual than those of a calibration text of its length."""
        data, at = utf8(_lower(col))
        total, n = np.zeros((len(at) - 1, len(self.languages) + 1)), np.zeros(len(at) - 1)
        tables = [*self.table, self.usual]
        for size, bucket in zip(SIZES, grams(data), strict=True):
            last = np.maximum(at[1:] - size + 1, at[:-1])  # grams that end within the text
            n += last - at[:-1]
            for k, table in enumerate(tables):
                run = np.concatenate(([0.0], np.cumsum(table[bucket], dtype=np.float64)))
                run = np.append(run, np.full(max(0, int(at[-1]) + 1 - len(run)), run[-1]))
                total[:, k] += run[last] - run[at[:-1]]
        total /= np.maximum(n, 1)[:, None]
        mean, between, one = self.spread
        return total[:, :-1] + self.bias, (total[:, -1] - mean) / np.sqrt(between + one / np.maximum(n, 1))

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether the text is rejected."""
        known = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(col), np.zeros(len(col)), np.ones(len(col), bool)
        z, deviation = self.logits(col)
        p = softmax(z)
        best, score = p.argmax(1), np.where(known, p.max(1), 0.0)
        rejected = ~known | (score < self.least) | (deviation < self.limit)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their shares, of each text and of two short cuts of it."""
    for batch in passes(batches):
        data, at = utf8(_lower(batch.column("text")))
        out = []
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            whole = data[at[i] : at[i + 1]]
            draw = np.random.default_rng(len(whole))
            cuts = [whole] + [whole[(s := int(draw.integers(0, max(1, len(whole) - 40)))) : s + int(draw.integers(20, 200))] for _ in range(2)]
            for part, cut in enumerate(cuts):
                bucket, n = np.unique(np.concatenate(grams(cut)), return_counts=True)
                if len(bucket):
                    out.append((i, lang, part, xxhash.xxh3_64_intdigest(whole.tobytes()) >> 1, int(n.sum()), bucket.astype(np.uint16).tobytes(), (n / n.sum()).astype(np.float32).tobytes()))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True)], names=["lang", "part", "doc", "n", "bucket", "share"])


def _views(cells: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers of each binary cell, read in place."""
    out = []
    for chunk in filter(len, cells.chunks):
        at, data = offsets(chunk), np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        out += [data[a:b].view(kind) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _descend(rows, target, n_languages: int, dim: int, epochs: int, rate: float, seed: int):
    draw = np.random.default_rng(seed)
    vectors = (draw.standard_normal((1 << BITS, dim)) * 0.1).astype(np.float32)
    weights = (draw.standard_normal((dim, n_languages)) * 0.1).astype(np.float32)
    bias = np.zeros(n_languages, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = draw.permutation(len(rows))
        for start in range(0, len(order), 16):
            some = order[start : start + 16]
            idx = np.concatenate([rows[i][0] for i in some])
            share = np.concatenate([rows[i][1] for i in some])[:, None]
            cut = np.cumsum([0] + [len(rows[i][0]) for i in some])
            hidden = np.add.reduceat(vectors[idx] * share, cut[:-1], axis=0)
            p = softmax(hidden @ weights + bias)
            p[np.arange(len(some)), target[some]] -= 1
            back = p @ weights.T
            weights -= step * hidden.T @ p / len(some) * 4
            bias -= step * p.mean(0)
            np.subtract.at(vectors, idx, step * share * np.repeat(back, np.diff(cut), axis=0) * 8)
    return vectors, weights, bias


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, budget: int = BUDGET, dim: int = 12, epochs: int = 8, rate: float = 1.0, seed: int = 7) -> Model:
    """A model from the rows of `docs` (doc_id, text, lang); rows with a null text or lang are not used.

    Every language is learned: from about `per_language` of its rows, or an even part of `budget` if that is less, or LEAST.
    """
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model([], np.zeros((0, 1 << BITS)), np.zeros(0), 0.0, np.zeros(1 << BITS), (0.0, 1.0, 1.0), 0.0)
    if not sizes:
        return nothing
    languages = sorted(sizes)
    each = max(min(per_language, budget / len(languages)), LEAST)
    share = docs.sparkSession.createDataFrame([(x, each / sizes[x]) for x in languages], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where(hash_share("doc_id") < F.col("share")).mapInArrow(_counts, "lang string, part int, doc long, n long, bucket binary, share binary").toArrow()
    parts = list(zip(_views(sample["bucket"], np.uint16), _views(sample["share"], np.float32), strict=True))
    lang = np.searchsorted(languages, sample["lang"].to_pylist())
    order = sorted(range(len(parts)), key=lambda i: (lang[i], hashlib.blake2b(parts[i][0].tobytes(), digest_size=16).digest()))  # whatever order they came in
    parts, part, target = [parts[i] for i in order], np.array(sample["part"])[order], lang[order]
    if not len(parts):
        return nothing
    doc, n = np.array(sample["doc"])[order], np.array(sample["n"])[order]
    held = mixed(doc.view(np.uint64) + np.uint64(seed)) % np.uint64(5) == 0  # a document with its cuts, and its copies
    learned = np.flatnonzero(~held) if (~held).any() else np.arange(len(parts))
    vectors, weights, bias = _descend([parts[i] for i in learned], target[learned], len(languages), dim, epochs, rate, seed)
    table = (vectors @ weights).T
    usual, spread, limit = _usual(parts, part, n, learned, np.flatnonzero(held))
    held = np.flatnonzero(held & (part == 0))
    scale, least = 1.0, 0.0
    if len(held):
        z = np.array([table[:, parts[i][0]] @ parts[i][1] for i in held]) + bias
        loss = {s: -np.log(np.maximum(softmax(z * s)[np.arange(len(held)), target[held]], 1e-9)).mean() for s in np.geomspace(0.1, 10, 41)}
        scale = min(loss, key=loss.get)
        p = softmax(z * scale)
        right = p.max(1)[p.argmax(1) == target[held]]
        least = float(min(MIXED, np.quantile(right, 0.001))) if len(right) else 0.0
    return Model(languages, (table * scale).astype(np.float32), bias * scale, least, usual, spread, limit)


#: The confidence limit is no higher: a text in two learned languages shows about a half for either and is kept.
MIXED = 0.35
#: A text is rejected as unlike all that was learned beyond so many deviations, and beyond this multiple of the calibration texts' extreme.
DEVIATIONS, EXTREME = 5.0, 1.25


def _usual(parts, part: np.ndarray, n: np.ndarray, learned: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, tuple[float, float, float], float]:
    """Log frequencies of the buckets among the learned texts; spread and limit of their means from the calibration texts."""
    total = np.ones(1 << BITS)
    for i in learned[part[learned] == 0]:
        total[parts[i][0]] += parts[i][1] * n[i]
    usual = np.log(total / total.sum()).astype(np.float32)
    if not len(held):
        return usual, (0.0, 1.0, 1.0), -np.inf
    means = np.array([usual[parts[i][0]] @ parts[i][1] for i in held], np.float64)
    whole = part[held] == 0
    mean = float(means[whole].mean()) if whole.any() else float(means.mean())
    between = float(means[whole].var()) if whole.any() else 0.0
    short = ~whole if (~whole).any() else whole
    one = float(np.mean(np.maximum((means[short] - mean) ** 2 - between, 0) * n[held][short]))
    deviation = (means - mean) / np.sqrt(max(between, 1e-6) + one / n[held])
    return usual, (mean, max(between, 1e-6), one), float(min(-DEVIATIONS, EXTREME * np.quantile(deviation, 0.0005)))


def predictions(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The `carry` columns of `docs` in struct doc, with lang_pred, score, rejected.

    A null text and one without a letter get `und` and score 0 and are rejected, other texts the likeliest language;
    those whose calibrated score is below the model's limit are rejected, and those whose n-grams are too unusual for every
    learned language. Very long texts are read whole, in a pass of their own; repeated rows are predicted alike. A model
    that learned nothing gives `und` throughout.
    """
    inside = "text" in carry  # then the text crosses to Python once, within doc
    out = docs.select(F.struct(*carry).alias("doc"), *([] if inside else ["text"]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in passes(batches, "doc.text" if inside else "text"):
            lang, score, rejected = model.predict(column(batch, "doc.text" if inside else "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc", "lang_pred", "score", "rejected"])

    schema = out.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema
    return out.mapInArrow(predict, schema)


def in_training(doc_id: str = "doc_id"):
    """Rows that the model may learn from: crc32 of the id as text, modulo 4, is not 2, and the id is not null."""
    return F.col(doc_id).isNotNull() & (remainder(doc_id, 4) != 2)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`; learned from the rows outside the held-out quarter."""
    model = train(docs.where(in_training()))
    out = predictions(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", remainder("doc_id", 4) == 2)


def of_known_language(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose language the model does not reject."""
    model = train(docs.where(in_training()))
    return predictions(docs, model, docs.columns).where(~F.col("rejected")).select("doc.*")
