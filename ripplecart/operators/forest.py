"""Honest causal forest on residuals, grown over the whole table at once.

Each tree sees a subsample; one half of it chooses the cuts, the other half fills the leaves. A cut maximises the
spread of the gradient pseudo-outcomes of its node's local regression (y on t, with an intercept). Effects of a row
solve the moments of its leaves, averaged over the trees; trees come in little bags that share a half-sample, and the
spread between bags gives the variance.

Subsamples are hashes of a row id, so any task knows the members of all trees and no sample is ever shuffled by itself.
Nodes with more members than ``node_rows`` are cut by histogram passes, one a level for all trees; the members of a smaller
node go to one task, which grows its whole subtree. Leaves are filled by one more pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.functions.distributed import settled
from ripplecart.operators.boosting import bin_edges, bin_matrix, binned, schema_without

U64 = np.uint64
MOMENTS = ("n", "t", "y", "tt", "ty")
SUMS = ("n", "rho", "held", "t", "y", "tt", "ty")


@dataclass(frozen=True)
class ForestSettings:
    """``sample``: share of rows a tree sees, at most a half; ``bag``: trees that share a half-sample; ``least_rows`` and
    ``least_share`` bound the smaller side of a cut, the first on both halves."""

    trees: int = 200
    depth: int = 8
    sample: float = 0.1
    bag: int = 4
    least_rows: int = 5
    least_share: float = 0.05
    bins: int = 63
    seed: int = 42
    node_rows: int = 100_000


class Forest:
    """All trees in heap order: children of node i are 2i + 1 (bin <= cut) and 2i + 2."""

    def __init__(self, settings: ForestSettings):
        size = (1 << (settings.depth + 1)) - 1
        self.settings = settings
        self.split = np.zeros((settings.trees, size), bool)
        self.feature = np.zeros((settings.trees, size), np.int16)
        self.cut = np.zeros((settings.trees, size), np.int16)

    def node_of(self, tree: int, bins: np.ndarray) -> np.ndarray:
        at, line = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.settings.depth):
            inner = self.split[tree, at]
            if not inner.any():
                break
            right = bins[line, self.feature[tree, at]] > self.cut[tree, at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    key = np.zeros(1, U64)
    for s in salt:
        key = _mixed(key * U64(31) + U64(s + 1))
    return (_mixed(ids ^ key) >> U64(11)).astype(np.float64) / float(1 << 53)


def members(ids: np.ndarray, tree: int, settings: ForestSettings) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tree's subsample, and which of them only fill leaves. Trees of a bag draw from the same half of the rows."""
    half = _uniform(ids, settings.seed, 1, tree // settings.bag) < 0.5
    rows = np.flatnonzero(half & (_uniform(ids, settings.seed, 2, tree) < 2 * settings.sample))
    return rows, _uniform(ids[rows], settings.seed, 3, tree) < 0.5


def local_regression(m: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Mean of t and of y, slope, and variance of t (0 where the node has none) from node moments."""
    n = np.maximum(m["n"], 1)
    t, y = m["t"] / n, m["y"] / n
    var = np.maximum(m["tt"] / n - t * t, 0.0)
    var = np.where(var > 1e-12 * np.maximum(m["tt"] / n, 1e-300), var, 0.0)
    return t, y, np.divide(m["ty"] / n - t * y, var, out=np.zeros_like(var), where=var > 0), var


def pseudo_outcomes(t: np.ndarray, y: np.ndarray, fit: tuple) -> np.ndarray:
    mean_t, mean_y, slope, var = fit
    d = t - mean_t
    return np.divide(d * (y - mean_y - slope * d), var, out=np.zeros_like(d), where=var > 0)


def best_split(sums: np.ndarray, settings: ForestSettings) -> tuple[float, int, int, np.ndarray]:
    """Gain, column, bin and the left side's sums for the (sums, column, bin) histogram of a node; gain 0: a leaf."""
    left = np.cumsum(sums, -1)
    total = left[..., -1:]
    right = total - left
    n, r, held = total[:3]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - r * r / n
    small, smaller = np.minimum(left[0], right[0]), np.minimum(left[2], right[2])
    fits = (small >= settings.least_rows) & (smaller >= settings.least_rows) & (small >= settings.least_share * n)
    gain = np.where(fits, gain, 0.0)
    best = gain.max()
    if best <= 1e-12:
        return 0.0, 0, 0, left[:, 0, 0]
    j, at = divmod(int((gain.ravel() >= best * (1 - 1e-9)).argmax()), gain.shape[1])
    return float(best), j, at, left[:, j, at]


def histogram(bins: np.ndarray, columns: list[np.ndarray], width: int) -> np.ndarray:
    """The columns summed by (column of the design, bin)."""
    out = np.zeros((len(columns), bins.shape[1], width))
    for j in range(bins.shape[1]):
        for k, c in enumerate(columns):
            out[k, j] = np.bincount(bins[:, j], c, width)
    return out


def _columns(t: np.ndarray, y: np.ndarray, held: np.ndarray, rho: np.ndarray) -> list[np.ndarray]:
    """The sums of a node's histogram: all but `held` are of the rows that choose cuts."""
    own = (~held).astype(np.float64)
    return [own, own * rho, held.astype(np.float64), own * t, own * y, own * t * t, own * t * y]


def grow(bins: np.ndarray, t: np.ndarray, y: np.ndarray, held: np.ndarray, depth: int, settings: ForestSettings) -> list[tuple[int, int, int]]:
    """Cuts (node, column, bin) of the subtree over these rows, its root numbered 0."""
    cuts, open_ = [], [(0, 0, np.arange(len(t)))]
    while open_:
        node, level, rows = open_.pop()
        own = rows[~held[rows]]
        if level == depth or len(own) < 2 * settings.least_rows:
            continue
        moments = {"n": len(own), "t": t[own].sum(), "y": y[own].sum(), "tt": (t[own] ** 2).sum(), "ty": (t[own] * y[own]).sum()}
        fit = local_regression({k: np.array([v], np.float64) for k, v in moments.items()})
        if fit[3][0] == 0:
            continue
        rho = pseudo_outcomes(t[rows], y[rows], tuple(x[0] for x in fit))
        hist = histogram(bins[rows], _columns(t[rows], y[rows], held[rows], rho)[:3], settings.bins + 1)
        gain, j, at, _ = best_split(hist, settings)
        if gain > 0:
            cuts.append((node, j, at))
            right = bins[rows, j] > at
            open_ += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return cuts


def _rebased(node: int, base: int) -> int:
    """The heap number of a subtree's node in the tree, the subtree's root being `base` there."""
    level = (node + 1).bit_length() - 1
    return ((base + 1) << level) - 1 + node + 1 - (1 << level)


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    return np.asarray(batch.column("id")).view(U64), bin_matrix(batch.column("bins"), width), np.asarray(batch.column("t")), np.asarray(batch.column("y"))


def _moments(forest, width: int, held_rows: bool):
    """Moments by (tree, node) of the rows that choose cuts, or of those that fill leaves."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        size = trees.split.shape[1]
        total = np.zeros((len(MOMENTS), trees.settings.trees, size))
        for batch in batches:
            ids, bins, t, y = _arrays(batch, width)
            for tree in range(trees.settings.trees):
                rows, held = members(ids, tree, trees.settings)
                rows = rows[held == held_rows]
                node = trees.node_of(tree, bins[rows])
                for k, c in enumerate((np.ones(len(rows)), t[rows], y[rows], t[rows] ** 2, t[rows] * y[rows])):
                    total[k, tree] += np.bincount(node, c, size)
        tree, node = np.nonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(node, pa.int32()), *[pa.array(c[tree, node]) for c in total]], names=["tree", "node", *MOMENTS])

    return summed


def _node_moments(design: DataFrame, forest: Forest, width: int, held: bool) -> np.ndarray:
    """(moment, tree, node) sums; as many numbers as the forest has nodes."""
    sent = design.sparkSession.sparkContext.broadcast(forest)
    rows = design.mapInArrow(_moments(sent, width, held), "tree int, node int, " + ", ".join(f"{m} double" for m in MOMENTS))
    out = np.zeros((len(MOMENTS), *forest.split.shape))
    for r in rows.groupBy("tree", "node").agg(*[F.sum(m).alias(m) for m in MOMENTS]).collect():
        out[:, r["tree"], r["node"]] = [r[m] for m in MOMENTS]
    return out


def _large_histograms(forest, large: dict[int, dict[int, tuple]], width: int):
    """Histograms of the large nodes, whose local regressions are given, by (tree, node, column)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held_sums = forest.value, {}
        for batch in batches:
            ids, bins, t, y = _arrays(batch, width)
            for tree, nodes in large.items():
                rows, held = members(ids, tree, trees.settings)
                at = trees.node_of(tree, bins[rows])
                for node, fit in nodes.items():
                    mine = at == node
                    r = rows[mine]
                    hist = histogram(bins[r], _columns(t[r], y[r], held[mine], pseudo_outcomes(t[r], y[r], fit)), trees.settings.bins + 1)
                    held_sums[tree, node] = held_sums[tree, node] + hist if (tree, node) in held_sums else hist
        for (tree, node), hist in held_sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * width, pa.int32()), pa.array([node] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([hist[:, j].tobytes() for j in range(width)], pa.binary())],
                names=["tree", "node", "column", "hist"],
            )

    return summed


def _search(settings: ForestSettings):
    def search(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(h, np.float64).reshape(len(SUMS), 1, settings.bins + 1) for h in parts.column("hist").to_pylist())
        gain, _, at, left = best_split(total, settings)
        out = {k: pa.array([v.as_py()], pa.int32()) for k, v in zip(("tree", "node", "column"), key, strict=True)}
        both = np.concatenate((left, total.sum((1, 2)) - left))
        return pa.table(out | {"gain": pa.array([gain]), "at": pa.array([at], pa.int32()), "sides": pa.array([both.tolist()], pa.list_(pa.float64()))})

    return search


def _members_of(forest, small: dict[int, set[int]], width: int):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in batches:
            ids, bins, t, y = _arrays(batch, width)
            for tree, nodes in small.items():
                rows, held = members(ids, tree, trees.settings)
                at = trees.node_of(tree, bins[rows])
                mine = np.isin(at, list(nodes))
                r = rows[mine]
                # one row per node: packed members, so that a subtree's rows travel as a few arrays
                node, order = at[mine], np.argsort(at[mine], kind="stable")
                cut = np.concatenate(([0], np.flatnonzero(np.diff(node[order])) + 1, [len(r)])) if len(r) else np.zeros(1, np.int64)
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    o = order[a:b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree], pa.int32()), pa.array([int(node[o[0]])], pa.int32())]
                        + [pa.array([x.tobytes()], pa.binary()) for x in (ids[r[o]], bins[r[o]], t[r[o]], y[r[o]], held[mine][o])],
                        names=["tree", "node", "ids", "bins", "t", "y", "held"],
                    )

    return sent


def _subtree(settings: ForestSettings, width: int):
    def grown(key: tuple, parts: pa.Table) -> pa.Table:
        tree, base = (k.as_py() for k in key)
        of = lambda c, kind: np.frombuffer(b"".join(parts.column(c).to_pylist()), kind)
        bins, t, y, held = of("bins", np.uint8).reshape(-1, width), of("t", np.float64), of("y", np.float64), of("held", bool)
        order = np.lexsort((y, t, of("ids", U64)))  # sums don't depend on the order of arrival
        level = (base + 1).bit_length() - 1
        cuts = grow(bins[order], t[order], y[order], held[order], settings.depth - level, settings)
        columns = list(zip(*[(tree, _rebased(n, base), j, at) for n, j, at in cuts], strict=True)) if cuts else [()] * 4
        return pa.table({k: pa.array(c, pa.int32()) for k, c in zip(("tree", "node", "column", "at"), columns, strict=True)})

    return grown


def grow_forest(design: DataFrame, width: int, settings: ForestSettings) -> Forest:
    """All trees over the saved design (id, bins, t, y)."""
    forest, context = Forest(settings), design.sparkSession.sparkContext
    at_root = _node_moments(design, forest, width, False)[:, :, 0]
    open_ = {(tree, 0): at_root[:, tree] for tree in range(settings.trees)}
    small: dict[int, set[int]] = {}
    for level in range(settings.depth):
        large: dict[int, dict[int, tuple]] = {}
        for (tree, node), m in open_.items():
            if m[0] * 2 > settings.node_rows:
                fit = tuple(x[0] for x in local_regression({k: np.array([v]) for k, v in zip(MOMENTS, m, strict=True)}))
                large.setdefault(tree, {})[node] = fit
            elif m[0] >= 2 * settings.least_rows:
                small.setdefault(tree, set()).add(node)
        open_ = {}
        if not large:
            break
        hists = design.mapInArrow(_large_histograms(context.broadcast(forest), large, width), "tree int, node int, column int, hist binary")
        schema = "tree int, node int, column int, gain double, at int, sides array<double>"
        best: dict[tuple[int, int], tuple] = {}
        for r in hists.groupBy("tree", "node", "column").applyInArrow(_search(settings), schema).collect():
            key = r["tree"], r["node"]
            if r["gain"] > 0 and (key not in best or (r["gain"], -r["column"]) > (best[key][0], -best[key][1])):
                best[key] = r["gain"], r["column"], r["at"], r["sides"]
        for (tree, node), (_, column, at, sides) in best.items():
            forest.split[tree, node], forest.feature[tree, node], forest.cut[tree, node] = True, column, at
            if level + 1 < settings.depth:
                pick = [0, *range(3, len(SUMS))]
                left, right = np.array(sides).reshape(2, -1)[:, pick]
                open_[tree, 2 * node + 1], open_[tree, 2 * node + 2] = left, right
    if small:
        packed = design.mapInArrow(_members_of(context.broadcast(forest), small, width), "tree int, node int, ids binary, bins binary, t binary, y binary, held binary")
        for r in packed.groupBy("tree", "node").applyInArrow(_subtree(settings, width), "tree int, node int, column int, at int").collect():
            forest.split[r["tree"], r["node"]], forest.feature[r["tree"], r["node"]], forest.cut[r["tree"], r["node"]] = True, r["column"], r["at"]
    return forest


def debiased(between: np.ndarray, noise: np.ndarray, bags: int) -> np.ndarray:
    """Variance between bags less the noise of finite bags, kept positive by an improper uniform prior on it."""
    start = between - noise
    spread = np.maximum(between, noise) * math.sqrt(2.0 / bags)
    ratio = np.divide(start, spread, out=np.zeros_like(start), where=spread > 0)
    erfc = np.array([math.erfc(-x / math.sqrt(2)) for x in ratio.ravel()]).reshape(ratio.shape)
    return start + spread * np.exp(-ratio * ratio / 2) / math.sqrt(2 * math.pi) / np.maximum(0.5 * erfc, 1e-12)


def effects_of(leaves: np.ndarray, bag: int) -> tuple[np.ndarray, np.ndarray]:
    """Effect and standard error of rows from the moments of their leaves: array (moment, row, tree)."""
    n, t, y, tt, ty = leaves
    good = n > 0
    size = np.where(good, n, 1)
    t, y, tt, ty = (np.where(good, x / size, 0.0) for x in (t, y, tt, ty))
    one = good.astype(np.float64)
    a, b, c, d, e = (x.sum(1) for x in (tt, t, one, ty, y))
    det = a * c - b * b
    det = np.where(np.abs(det) > 1e-300, det, np.nan)
    effect, intercept = (c * d - b * e) / det, (a * e - b * d) / det
    trees = one.sum(1)
    first = ty - tt * effect[:, None] - t * intercept[:, None]
    second = y - t * effect[:, None] - one * intercept[:, None]
    # influence of each tree on the effect, times the number of trees
    psi = ((c[:, None] * first - b[:, None] * second) / det[:, None]) * trees[:, None]
    whole = psi[:, : psi.shape[1] // bag * bag].reshape(len(psi), -1, bag)
    by_bag = whole.mean(2)
    between = (by_bag**2).mean(1)
    within = ((whole - by_bag[:, :, None]) ** 2).mean((1, 2)) / max(bag - 1, 1)
    return effect, np.sqrt(debiased(between, within, by_bag.shape[1]))


def _effects(forest, leaves, width: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, moments = forest.value, leaves.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                bins = bin_matrix(part.column("bins"), width)
                cells, back = np.unique(bins, axis=0, return_inverse=True)  # rows with equal covariates have equal effects
                at = np.stack([trees.node_of(tree, cells) for tree in range(trees.settings.trees)], 1)
                effect, se = effects_of(moments[:, np.arange(trees.settings.trees), at], trees.settings.bag)
                rest = [c for c in part.schema.names if c not in ("id", "bins")]
                back = back.ravel()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(effect[back]), pa.array(se[back])], names=[*rest, "cate", "cate_se"])

    return scored


def causal_forest(res: DataFrame, keys: list[str], settings: ForestSettings | None = None) -> DataFrame:
    """Keys, t, y, cate and cate_se of every row of residuals (``y_res``, ``t_res``, covariates ``w``).

    ``keys`` identify a row: subsamples are drawn by their hash. The forest (trees x nodes) and its leaf moments are broadcast, a
    size that the settings fix.
    """
    settings = settings or ForestSettings()
    if not 0 < settings.sample <= 0.5:
        raise ValueError("sample must lie in (0, 0.5]")
    if settings.trees % settings.bag or settings.trees < 2 * settings.bag:
        raise ValueError("the trees must fill two bags or more")
    head = res.select(F.size("w").alias("k")).first()
    if head is None:
        raise ValueError("no rows to fit on")
    width = int(head["k"])
    rows = res.select(*keys, F.xxhash64(*keys).alias("id"), F.col("t_res").alias("t"), F.col("y_res").alias("y"), "w")
    design = settled(binned(rows, bin_edges(res, width, settings.bins)), "forest")
    narrow = design.select("id", "bins", "t", "y")
    forest = grow_forest(narrow, width, settings)
    leaves = _node_moments(narrow, forest, width, True)
    context = res.sparkSession.sparkContext
    made = _effects(context.broadcast(forest), context.broadcast(leaves), width)
    return design.mapInArrow(made, f"{schema_without(design, 'id', 'bins')}, cate double, cate_se double")
