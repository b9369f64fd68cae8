"""Skip-gram with negative sampling, its vectors dealt out by node and exchanged in rotating blocks.

Nodes are hashed into P blocks. A training pair belongs to the bucket (block of its centre, block of its context). A
round of an epoch trains P buckets side by side, (b, b + s mod P) for every b: no two of them share a vector, so each task owns the
input vectors of one block and the output vectors of another while it runs, and hands both back. P rounds make
an epoch. Negatives come from the task's output block, by node frequency to the power 3/4; over an epoch every block is met.

Nothing of the vocabulary's size reaches the driver: vectors live in a table with a row per block, written after each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecart.config import PRODUCT
from ripplecart.functions.distributed import settled

#: Nodes of a block, and pairs of a bucket: what one task holds.
BLOCK_NODES = 25_000
BUCKET_PAIRS = 2_000_000


@dataclass(frozen=True)
class SkipGramSettings:
    dim: int = 64
    window: int = 5
    epochs: int = 5
    negatives: int = 5
    step: float = 0.025
    last_step: float = 0.0001
    seed: int = 42


def block_of(node: Column, blocks: int) -> Column:
    mixed = F.shiftright(node.bitwiseAND(0x3FFFFFFF) * F.lit(2654435761), 16)
    return F.pmod(mixed, F.lit(blocks)).cast("int")


def _block_of(node: np.ndarray, blocks: int) -> np.ndarray:
    return (((node & 0x3FFFFFFF) * 2654435761) >> 16) % blocks


def _hashed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(11)


def window_pairs(node: np.ndarray, walk: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and contexts: neighbours of a walk within a reach that each position draws from 1 to ``window``."""
    place = np.arange(len(node))
    starts = np.searchsorted(walk, walk)
    reach = 1 + _hashed(node * 1_000_003 + node[starts] * 8191 + (place - starts) * 131 + seed) % np.uint64(window)
    centres, contexts = [], []
    for d in range(1, window + 1):
        same = np.flatnonzero(walk[d:] == walk[:-d]) if len(node) > d else np.zeros(0, np.int64)
        for a, b in ((same, same + d), (same + d, same)):
            near = reach[a] >= d
            centres.append(node[a[near]])
            contexts.append(node[b[near]])
    return np.concatenate(centres), np.concatenate(contexts)


def _bucketed(window: int, blocks: int, seed: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("walk")
            node = np.asarray(column.flatten().cast(pa.int64()))
            sizes = np.diff(np.asarray(column.offsets))
            centre, context = window_pairs(node, np.repeat(np.arange(len(sizes)), sizes), window, seed)
            bucket = _block_of(centre, blocks) * blocks + _block_of(context, blocks)
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            bounds = [*first.tolist(), len(order)]
            cut = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())  # noqa: B023, E731
            b, c = np.divmod(used, blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), pa.array((c - b) % blocks, pa.int32()), cut(centre), cut(context)], names=["block", "turn", "centres", "contexts"]
            )

    return pairs


STATE = "side int, block int, nodes binary, counts binary, vectors binary, loss double, pairs long"


def _started(settings: SkipGramSettings):
    def start(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        node = np.asarray(rows.column("node"))
        order = np.argsort(node)
        count = np.asarray(rows.column("n"))[order]
        rng = np.random.default_rng([settings.seed, block])
        inputs = ((rng.random((len(node), settings.dim)) - 0.5) / settings.dim).astype(np.float32)
        both = (inputs, np.zeros_like(inputs))
        return pa.table({
            "side": pa.array([0, 1], pa.int32()), "block": pa.array([block] * 2, pa.int32()), "nodes": pa.array([node[order].tobytes()] * 2, pa.binary()),
            "counts": pa.array([count.astype(np.int64).tobytes()] * 2, pa.binary()), "vectors": pa.array([x.tobytes() for x in both], pa.binary()),
            "loss": pa.array([0.0] * 2), "pairs": pa.array([0] * 2, pa.int64()),
        })

    return start


def _added(target: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    """target[at] += change with repeated places summed."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    target[at[first]] += np.add.reduceat(change[order], first, axis=0)


def train_bucket(
    inputs: np.ndarray, outputs: np.ndarray, counts: np.ndarray, centre: np.ndarray, context: np.ndarray, step: float, negatives: int, rng: np.random.Generator
) -> float:
    """One pass of the pairs in random order, in place; returns the summed loss before each update."""
    odds = np.cumsum(counts.astype(np.float64) ** 0.75)
    order, loss = rng.permutation(len(centre)), 0.0
    batch = int(np.clip(4 * min(len(inputs), len(outputs)), 64, 4096))
    for first in range(0, len(order), batch):
        rows = order[first : first + batch]
        i, j = centre[rows], context[rows]
        drawn = np.minimum(np.searchsorted(odds, rng.random((len(rows), negatives)) * odds[-1], "right"), len(counts) - 1)
        target = np.concatenate((j[:, None], drawn), 1)
        label = np.zeros(target.shape, np.float32)
        label[:, 0] = 1
        used = np.ones(target.shape, np.float32)
        used[:, 1:] = drawn != j[:, None]  # a drawn context is no negative
        h, out = inputs[i], outputs[target]
        score = np.clip(np.einsum("bd,bkd->bk", h, out), -30, 30)
        loss += float((np.logaddexp(0, np.where(label > 0, -score, score)) * used).sum())
        g = (label - 1 / (1 + np.exp(-score))) * used * np.float32(step)
        _added(inputs, i, np.einsum("bk,bkd->bd", g, out).astype(np.float32))
        _added(outputs, target.ravel(), (g[:, :, None] * h[:, None, :]).reshape(-1, h.shape[1]).astype(np.float32))
    return loss


def _round(settings: SkipGramSettings, epoch: int, turn: int, step: float):
    def train(pairs: pa.Table, owned: pa.Table) -> pa.Table:
        own = {r["side"]: r for r in owned.to_pylist()}
        of = lambda side, name, kind: np.frombuffer(own[side][name], kind)
        vectors = [of(side, "vectors", np.float32).reshape(-1, settings.dim).copy() for side in (0, 1)]
        joined = lambda name: np.frombuffer(b"".join(pairs.column(name).to_pylist()), np.int64)
        centre, context = (np.searchsorted(of(side, "nodes", np.int64), joined(name)) for side, name in ((0, "centres"), (1, "contexts")))
        order = np.lexsort((context, centre))  # the draw must not depend on the order of arrival
        rng = np.random.default_rng([settings.seed, epoch, turn, own[0]["block"]])
        loss = train_bucket(*vectors, of(1, "counts", np.int64), centre[order], context[order], step, settings.negatives, rng) if len(order) else 0.0
        sides = [0, 1]
        return pa.table({
            "side": pa.array(sides, pa.int32()), "block": pa.array([own[s]["block"] for s in sides], pa.int32()),
            "nodes": pa.array([own[s]["nodes"] for s in sides], pa.binary()), "counts": pa.array([own[s]["counts"] for s in sides], pa.binary()),
            "vectors": pa.array([v.tobytes() for v in vectors], pa.binary()),
            "loss": pa.array([own[0]["loss"] + loss, own[1]["loss"]]), "pairs": pa.array([own[0]["pairs"] + len(order), own[1]["pairs"]], pa.int64()),
        })

    return train


@dataclass(frozen=True)
class SkipGram:
    """``vectors``: (PRODUCT_ID, embedding). ``losses``: mean loss of a pair in each epoch."""

    vectors: DataFrame
    losses: list[float]
    blocks: int


def train_skip_gram(
    walks: DataFrame, settings: SkipGramSettings | None = None, *, block_nodes: int = BLOCK_NODES, bucket_pairs: int = BUCKET_PAIRS
) -> SkipGram:
    """Vectors of all nodes in ``walks`` (column walk, an array of ids); walks are never cut.

    The number of blocks follows the nodes and the pairs, so that a task's vectors and pairs stay bounded: an epoch is P
    jobs of P tasks. Nodes that only stand alone in their walks keep their start vectors.
    """
    settings = settings or SkipGramSettings()
    walks = walks.select(F.col("walk").cast("array<bigint>").alias("walk"))
    nodes = settled(walks.select(F.explode("walk").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")), "nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("steps")).first()
    blocks = max(1, -(-size["nodes"] // block_nodes), math.ceil(math.sqrt(size["steps"] * (settings.window + 1) / bucket_pairs)))
    rows = walks.mapInArrow(_bucketed(settings.window, blocks, settings.seed), "block int, turn int, centres binary, contexts binary")
    pairs = settled(rows, "pairs", partition_by=("turn",))
    state = nodes.withColumn("block", block_of(F.col("node"), blocks)).groupBy("block").applyInArrow(_started(settings), STATE)
    state = settled(state, "vectors")
    losses, total = [], 0.0
    for epoch in range(settings.epochs):
        for turn in range(blocks):
            done = (epoch * blocks + turn) / max(settings.epochs * blocks, 1)
            step = settings.step + (settings.last_step - settings.step) * done
            owner = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - turn, F.lit(blocks)))
            held = state.withColumn("owner", owner.cast("int"))
            # a block without a partner has no pairs in this turn and passes through
            alone = held.groupBy("owner").agg(F.count(F.lit(1)).alias("sides")).where("sides < 2").select("owner")
            trained = (
                pairs.where(F.col("turn") == turn).groupBy("block")
                .cogroup(held.join(F.broadcast(alone), "owner", "left_anti").groupBy("owner"))
                .applyInArrow(_round(settings, epoch, turn, step), STATE)
            )
            state = settled(trained.unionByName(held.join(F.broadcast(alone), "owner", "left_semi").drop("owner")), "vectors")
        so_far = state.where("side = 0").agg(F.sum("loss").alias("loss"), F.sum("pairs").alias("pairs")).first()
        losses.append(((so_far["loss"] or 0.0) - total) / max((so_far["pairs"] or 0) / (epoch + 1), 1))
        total = so_far["loss"] or 0.0
    vectors = state.where("side = 0").mapInArrow(_as_rows(settings.dim), f"{PRODUCT} long, embedding array<float>")
    return SkipGram(vectors, losses, blocks)


def _as_rows(dim: int):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, vectors in zip(batch.column("nodes").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                node = np.frombuffer(nodes, np.int64)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1) * dim, pa.int32()), pa.array(np.frombuffer(vectors, np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(node), made], names=[PRODUCT, "embedding"])

    return unpack
