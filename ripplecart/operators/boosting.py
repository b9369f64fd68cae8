"""Boosted trees on histograms: all folds and targets at once, over one binned design.

The covariates are binned once (at most 256 bins a column, from quantile sketches) and rows with the same fold and
bins are one *cell* with its row count and target sums. Squared loss needs no more: rows of a cell share their
prediction, so the cell table is an exact compression of the design, saved once for all models.

A model is a (left-out fold, target) pair. Trees grow to a depth, leaf by leaf in order of gain up to a number of leaves; a
node's gain does not depend on when it is reached, so every tree is grown level by level and cut back to the leaves that
the best-first order takes. There are two ways to run the levels, with the same trees:

* *By model*: a cell table below ``task_entries`` values goes to one task per model, which boosts all rounds there. One job.
* *By level*: beyond that, one pass over the cells a level serves all models. Tasks hand out partial histograms per (model,
  node, feature), these are summed and searched where they meet, and one row per node and feature reaches the driver.
  Scores are written every ``keep`` rounds; between, a pass replays the last few trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecart.functions.distributed import settled

BINS = 256
#: Cells times columns that one task boosts by itself.
TASK_ENTRIES = 16_000_000
#: Rounds between two writes of the scores when levels are passes.
KEEP = 8


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 200
    depth: int = 6
    leaves: int = 31
    step: float = 0.1
    least_rows: int = 20
    bins: int = BINS - 1


@dataclass
class Tree:
    """A tree in heap order: node i has the children 2i + 1 (bin <= cut) and 2i + 2. ``value`` holds for every node that is reached."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    split: np.ndarray

    def leaf_of(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        line = np.arange(len(bins))
        for _ in range(depth):
            inner = self.split[at]
            if not inner.any():
                break
            right = bins[line, self.feature[at]] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


# ── one node level ────────────────────────────────────────────────────────────


def node_histograms(bins: np.ndarray, node: np.ndarray, n: np.ndarray, g: np.ndarray, nodes: int) -> np.ndarray:
    """Counts and residual sums by (node, feature, bin): array (2, nodes, features, BINS)."""
    out = np.empty((2, nodes, bins.shape[1], BINS))
    for j in range(bins.shape[1]):
        key = node * BINS + bins[:, j]
        out[0, :, j] = np.bincount(key, n, nodes * BINS).reshape(nodes, BINS)
        out[1, :, j] = np.bincount(key, g, nodes * BINS).reshape(nodes, BINS)
    return out


def best_cuts(hist: np.ndarray, least_rows: int) -> tuple[np.ndarray, ...]:
    """Best cut of each (node, feature) histogram: gain (0 where none), bin, and left count and sum, and total count and sum.

    Gains that agree to nine digits are ties; the lowest bin wins, so the order of summation does not decide.
    """
    left = np.cumsum(hist, -1)
    total = left[..., -1:]
    right = total - left
    (nl, gl), (nr, gr), (n, g) = left, right, total
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / nl + gr * gr / nr - g * g / n
    fits = (np.round(nl) >= least_rows) & (np.round(nr) >= least_rows)
    gain = np.where(fits, gain, 0.0)
    best = gain.max(-1)
    at = (gain >= best[..., None] * (1 - 1e-9)).argmax(-1)
    gain = np.where(best > 1e-9 * np.maximum(1.0, np.abs(g[..., 0])), best, 0.0)
    take = lambda x: np.take_along_axis(x, at[..., None], -1)[..., 0]
    return gain, at, take(nl), take(gl), n[..., 0], g[..., 0]


class Grower:
    """A tree while it grows: cuts of all nodes down to the depth, then the best-first choice of leaves."""

    def __init__(self, depth: int):
        size = (1 << (depth + 1)) - 1
        self.depth = depth
        self.gain = np.zeros(size)
        self.feature = np.zeros(size, np.int16)
        self.cut = np.zeros(size, np.int16)
        self.n = np.zeros(size)
        self.g = np.zeros(size)

    def take(self, node: int, gain: np.ndarray, at: np.ndarray, nl: np.ndarray, gl: np.ndarray, n: np.ndarray, g: np.ndarray) -> None:
        """The best cut of a node from those of its features; the first feature wins a tie."""
        j = int((gain >= gain.max() * (1 - 1e-9)).argmax())
        if node == 0:
            self.n[0], self.g[0] = n[j], g[j]
        if gain[j] > 0:
            self.gain[node], self.feature[node], self.cut[node] = gain[j], j, at[j]
            for child, a, b in ((2 * node + 1, nl[j], gl[j]), (2 * node + 2, n[j] - nl[j], g[j] - gl[j])):
                self.n[child], self.g[child] = a, b

    def grown(self, settings: BoostSettings) -> Tree:
        split = np.zeros(len(self.gain), bool)
        open_, leaves = {0}, 1
        while leaves < settings.leaves:
            node = max(open_, key=lambda i: (self.gain[i], -i), default=None)
            if node is None or self.gain[node] <= 0:
                break
            split[node] = True
            open_.remove(node)
            open_ |= {2 * node + 1, 2 * node + 2}
            leaves += 1
        value = settings.step * np.divide(self.g, self.n, out=np.zeros_like(self.g), where=self.n > 0)
        return Tree(self.feature, self.cut, value, split)


def route(grower: Grower, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Rows one level down; rows of nodes without a cut stay where they are, at -1."""
    inside = node >= 0
    at = np.where(inside, node, 0)
    cut = inside & (grower.gain[at] > 0)
    right = bins[np.arange(len(bins)), grower.feature[at]] > grower.cut[at]
    return np.where(cut, 2 * at + 1 + right, -1)


def boost(bins: np.ndarray, n: np.ndarray, s: np.ndarray, settings: BoostSettings) -> tuple[float, list[Tree]]:
    """Start value and trees of one model from cells: bins, row counts, target sums."""
    start = float(s.sum() / max(n.sum(), 1))
    score, trees = np.full(len(n), start), []
    for _ in range(settings.rounds):
        g = s - n * score
        grower, node = Grower(settings.depth), np.zeros(len(n), np.int64)
        for level in range(settings.depth):
            first, inside = (1 << level) - 1, node >= 0
            if not inside.any():
                break
            keep = slice(None) if inside.all() else inside
            hist = node_histograms(bins[keep], node[keep] - first, n[keep], g[keep], first + 1)
            cuts = best_cuts(hist, settings.least_rows)
            for at in np.unique(node[keep]).tolist():
                grower.take(at, *(c[at - first] for c in cuts))
            node = route(grower, node, bins)
        tree = grower.grown(settings)
        score += tree.value[tree.leaf_of(bins, settings.depth)]
        trees.append(tree)
    return start, trees


# ── the design ────────────────────────────────────────────────────────────────


def bin_edges(df: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Ascending upper bounds per column of ``w``; a value's bin is the number of bounds below it.

    From one pass of quantile sketches; a column with fewer distinct values than bins keeps them all apart.
    """
    probs = [float(q) for q in np.linspace(0, 1, bins + 1)[1:-1]]
    sketch = [F.percentile_approx(F.col("w")[j], probs, 10_000).alias(f"q{j}") for j in range(width)]
    row = df.agg(*sketch).first()
    return [np.unique(np.array(row[f"q{j}"] or [0.0], np.float64)) for j in range(width)]


def schema_without(df: DataFrame, *dropped: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in dropped)


def binned(df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``df`` with the covariate array ``w`` as one byte per column, ``bins``."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("w")
            w = np.asarray(column.flatten()).reshape(batch.num_rows, len(edges)) if batch.num_rows else np.zeros((0, len(edges)))
            out = np.empty(w.shape, np.uint8)
            for j, e in enumerate(edges):
                out[:, j] = np.searchsorted(e, w[:, j], "left")
            rest = [c for c in batch.schema.names if c != "w"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([x.tobytes() for x in out], pa.binary())], names=[*rest, "bins"])

    return df.mapInArrow(code, f"{schema_without(df, 'w')}, bins binary")


def _cells(design: DataFrame, targets: list[str]) -> DataFrame:
    sums = [F.sum(F.col(t).cast("double")).alias(f"s{i}") for i, t in enumerate(targets)]
    return settled(design.groupBy("fold", "bins").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums), "cells")


def bin_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


# ── by model ──────────────────────────────────────────────────────────────────

FITTED = "fold int, target int, round int, start double, feature binary, cut binary, value binary, split binary"


def _packed(fold: int, target: int, start: float, trees: list[Tree]) -> pa.Table:
    columns = {
        "fold": pa.array([fold] * len(trees), pa.int32()), "target": pa.array([target] * len(trees), pa.int32()),
        "round": pa.array(range(len(trees)), pa.int32()), "start": pa.array([start] * len(trees), pa.float64()),
    }
    for name, kind in (("feature", np.int16), ("cut", np.int16), ("value", np.float64), ("split", np.bool_)):
        columns[name] = pa.array([getattr(t, name).astype(kind).tobytes() for t in trees], pa.binary())
    return pa.table(columns)


def _unpacked(row) -> Tree:
    of = lambda name, kind: np.frombuffer(row[name], kind)
    return Tree(of("feature", np.int16), of("cut", np.int16), of("value", np.float64), of("split", np.bool_))


def _fit_by_model(cells: DataFrame, targets: int, folds: int, width: int, settings: BoostSettings) -> dict[tuple[int, int], tuple[float, list[Tree]]]:
    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        fold, target = (k.as_py() for k in key)
        n, s = rows.column("n").to_numpy(), rows.column("s").to_numpy()
        # the sums of a node must not depend on the order in which rows arrive
        bins = bin_matrix(rows.column("bins"), width)
        order = np.lexsort(bins.T[::-1])
        return _packed(fold, target, *boost(bins[order], n[order], s[order], settings))

    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold")))
    one = F.posexplode(F.array(*[F.col(f"s{i}") for i in range(targets)])).alias("target", "s")
    jobs = cells.select(other.alias("left"), "bins", "n", *[f"s{i}" for i in range(targets)]).select("left", "bins", "n", one)
    merged = jobs.groupBy("left", "target", "bins").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))  # folds that share a cell
    fitted = merged.repartition(folds * targets, "left", "target").groupBy("left", "target").applyInArrow(fit, FITTED)
    models: dict[tuple[int, int], tuple[float, list[Tree]]] = {}
    for row in sorted(fitted.collect(), key=lambda r: (r["fold"], r["target"], r["round"])):  # trees: folds x targets x rounds
        models.setdefault((row["fold"], row["target"]), (row["start"], []))[1].append(_unpacked(row))
    return models


# ── by level ──────────────────────────────────────────────────────────────────


def _partial_histograms(width: int, growers: dict[tuple[int, int], Grower], level: int, pending: dict, depth: int, folds: int, targets: int):
    """Partial sums of a task's cells by (model, node, feature), bins as one array."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            bins, fold, n = bin_matrix(batch.column("bins"), width), np.asarray(batch.column("fold")), np.asarray(batch.column("n"))
            scores = np.asarray(batch.column("scores").flatten()).reshape(len(n), folds * targets)
            for (f, t), grower in growers.items():
                rows = fold != f
                if not rows.any():
                    continue
                mine = bins[rows]
                score = scores[rows, f * targets + t]
                for tree in pending[f, t]:
                    score = score + tree.value[tree.leaf_of(mine, depth)]
                g = np.asarray(batch.column(f"s{t}"))[rows] - n[rows] * score
                node = np.zeros(len(mine), np.int64)
                for _ in range(level):
                    node = route(grower, node, mine)
                keep = node >= 0
                used, local = np.unique(node[keep], return_inverse=True)
                hist = node_histograms(mine[keep], local, n[rows][keep], g[keep], len(used))
                for i, at in enumerate(used.tolist()):
                    key = f * targets + t, at
                    held[key] = held[key] + hist[:, i] if key in held else hist[:, i].copy()
        for (model, at), hist in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * width, pa.int32()), pa.array([at] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([hist[:, j].tobytes() for j in range(width)], pa.binary())],
                names=["model", "node", "feature", "hist"],
            )

    return summed


def _search(least_rows: int):
    def search(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(h, np.float64).reshape(2, 1, BINS) for h in parts.column("hist").to_pylist())
        found = best_cuts(total, least_rows)
        names = ("gain", "at", "nl", "gl", "n", "g")
        return pa.table({**{k: pa.array([v.as_py()], pa.int32()) for k, v in zip(("model", "node", "feature"), key, strict=True)}, **{k: pa.array([float(v[0])], pa.float64()) for k, v in zip(names, found, strict=True)}})

    return search


def _rescored(width: int, pending: dict, depth: int, folds: int, targets: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bin_matrix(batch.column("bins"), width)
            scores = np.asarray(batch.column("scores").flatten()).reshape(len(bins), folds * targets).copy()
            for (f, t), trees in pending.items():
                for tree in trees:
                    scores[:, f * targets + t] += tree.value[tree.leaf_of(bins, depth)]
            rest = [c for c in batch.schema.names if c != "scores"]
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * folds * targets, pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), made], names=[*rest, "scores"])

    return score


def _fit_by_level(cells: DataFrame, targets: int, folds: int, width: int, settings: BoostSettings, keep: int) -> dict[tuple[int, int], tuple[float, list[Tree]]]:
    per_fold = cells.groupBy("fold").agg(F.sum("n").alias("n"), *[F.sum(f"s{t}").alias(f"s{t}") for t in range(targets)]).collect()
    starts = {
        (f, t): sum(r[f"s{t}"] for r in per_fold if r["fold"] != f) / max(sum(r["n"] for r in per_fold if r["fold"] != f), 1)
        for f in range(folds) for t in range(targets)
    }
    first = F.array(*[F.lit(float(starts[f, t])) for f in range(folds) for t in range(targets)])
    scored = settled(cells.withColumn("scores", first), "scores")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields if f.name != "scores") + ", scores array<double>"
    models: dict[tuple[int, int], tuple[float, list[Tree]]] = {m: (starts[m], []) for m in starts}
    written = 0
    for done in range(settings.rounds):
        if done - written == keep:
            pending = {m: trees[written:] for m, (_, trees) in models.items()}
            scored, written = settled(scored.mapInArrow(_rescored(width, pending, settings.depth, folds, targets), fields), "scores"), done
        pending = {m: trees[written:] for m, (_, trees) in models.items()}
        growers = {m: Grower(settings.depth) for m in models}
        for level in range(settings.depth):
            partial = scored.mapInArrow(_partial_histograms(width, growers, level, pending, settings.depth, folds, targets), "model int, node int, feature int, hist binary")
            found = partial.groupBy("model", "node", "feature").applyInArrow(
                _search(settings.least_rows), "model int, node int, feature int, gain double, at double, nl double, gl double, n double, g double"
            )
            by_node: dict[tuple[int, int], list] = {}
            for row in found.collect():  # models x nodes x columns
                by_node.setdefault((row["model"], row["node"]), []).append(row)
            for (model, node), rows in by_node.items():
                rows.sort(key=lambda r: r["feature"])
                growers[divmod(model, targets)].take(node, *(np.array([r[c] for r in rows]) for c in ("gain", "at", "nl", "gl", "n", "g")))
            if not any(r["gain"] > 0 for rows in by_node.values() for r in rows):
                break
        for m, grower in growers.items():
            models[m][1].append(grower.grown(settings))
    return models


# ── out-of-fold predictions ───────────────────────────────────────────────────


def _predicted(models, targets: int, width: int, depth: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ensembles = models.value
        for batch in batches:
            bins, fold = bin_matrix(batch.column("bins"), width), np.asarray(batch.column("fold"))
            hats = np.zeros((targets, len(bins)))
            for f in np.unique(fold).tolist():
                rows = np.flatnonzero(fold == f)
                cells, back = np.unique(bins[rows], axis=0, return_inverse=True)
                for t in range(targets):
                    start, trees = ensembles[f, t]
                    score = np.full(len(cells), start)
                    for tree in trees:
                        score += tree.value[tree.leaf_of(cells, depth)]
                    hats[t, rows] = score[back.ravel()]
            rest = [c for c in batch.schema.names if c != "bins"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, hats)], names=[*rest, *[f"_hat{t}" for t in range(targets)]])

    return predict


def boosted_predictions(
    df: DataFrame, targets: list[str], folds: int, settings: BoostSettings | None = None, *, task_entries: int = TASK_ENTRIES, keep: int = KEEP
) -> DataFrame:
    """``df`` (with ``fold`` and the covariate array ``w``) without ``w``, with ``_hat0``, ``_hat1``, ...: out-of-fold predictions of the targets.

    Models are folds x targets ensembles in flattened form; they are broadcast to the scoring pass, a size fixed by the settings.
    """
    settings = settings or BoostSettings()
    head = df.select(F.size("w").alias("k")).first()
    if head is None:
        raise ValueError("no rows to fit on")
    width = int(head["k"])
    edges = bin_edges(df, width, settings.bins)
    design = settled(binned(df, edges), "binned")
    cells = _cells(design, targets)
    if cells.count() * width <= task_entries:
        models = _fit_by_model(cells, len(targets), folds, width, settings)
    else:
        models = _fit_by_level(cells, len(targets), folds, width, settings, keep)
    held = df.sparkSession.sparkContext.broadcast(models)
    hats = ", ".join(f"_hat{t} double" for t in range(len(targets)))
    return design.mapInArrow(_predicted(held, len(targets), width, settings.depth), f"{schema_without(design, 'bins')}, {hats}")


def residual_columns(targets: list[str]) -> list[Column]:
    return [(F.col(t).cast("double") - F.col(f"_hat{i}")).alias(f"{t}_res") for i, t in enumerate(targets)]
