"""Linear stages as distributed sufficient statistics: triangular factors, robust and clustered errors.

Only matrices of size (coefficients x coefficients) reach the driver, where they are solved. Coefficients come from
triangular factors rather than Gram sums: a Gram matrix has the square of the design's condition number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecart.functions.distributed import settled


def z_value(confidence_level: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - confidence_level) / 2)


def solve_min_norm(gram: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-norm solution and pseudo-inverse; columns are scaled to unit diagonal before."""
    scale = np.sqrt(np.diag(gram))
    scale = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0.0)
    inv = np.linalg.pinv(gram * np.outer(scale, scale), rcond=1e-13, hermitian=True) * np.outer(scale, scale)
    return inv @ rhs, inv


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _symmetric(values: dict, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i, j in _upper(k):
        m[i, j] = m[j, i] = values[(i, j)]
    return m


@dataclass(frozen=True)
class LinearFit:
    beta: np.ndarray
    se: np.ndarray
    cov: np.ndarray
    n: int
    r_squared: float | None = None

    def interval(self, confidence_level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
        z = z_value(confidence_level)
        return self.beta - z * self.se, self.beta + z * self.se


def ols_hc1(df: DataFrame, y: Column, regressors: list[Column]) -> LinearFit:
    """OLS with HC1 errors in two passes: the triangular factor, then the residual-weighted Gram matrix.

    ``regressors`` must contain the constant, if one is wanted, as its first entry.
    """
    k = len(regressors)
    xs = [f"_x{i}" for i in range(k)]
    rows = df.select(y.cast("double").alias("_y"), *[x.cast("double").alias(n) for x, n in zip(regressors, xs, strict=True)])
    factors = triangular_factors(rows, lambda c: (np.column_stack([c[x] for x in xs]), c["_y"][:, None], None), k, 1)
    factor, n = factors.get(0, (np.zeros((k + 1, k + 1)), 0))
    betas, inv = solve_triangular(factor, k)
    beta = betas[:, 0]
    fitted = reduce(lambda a, b: a + b, [F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)])
    e2 = (F.col("_y") - fitted) * (F.col("_y") - fitted)
    second = (
        rows.withColumn("_e2", e2)
        .agg(
            F.sum("_e2").alias("sse"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("syy"),
            *[F.sum(F.col("_e2") * F.col(xs[i]) * F.col(xs[j])).alias(f"m{i}_{j}") for i, j in _upper(k)],
        )
        .first()
    )
    meat = _symmetric({(i, j): second[f"m{i}_{j}"] for i, j in _upper(k)}, k)
    cov = inv @ meat @ inv * (n / (n - k))
    tss = second["syy"] - second["sy"] ** 2 / n
    return LinearFit(beta, np.sqrt(np.diag(cov)), cov, n, 1 - second["sse"] / tss if tss > 0 else None)


def clustered_ols(
    df: DataFrame, y: str, treatments: list[str], cluster_1: str, cluster_2: str
) -> LinearFit:
    """No-intercept OLS with two-way clustered errors, V1 + V2 - V12, from ONE pass over the rows.

    Scores are linear in the coefficients: the cross sums of y and the regressors per (cluster 1,
    cluster 2) pair give the Gram matrix, the coefficients and every cluster's score. The rows are
    aggregated to pairs once; all later sums read only that pair table. Negative eigenvalues of the
    combined variance are raised to 0.
    """
    k = len(treatments)
    t = [F.col(c) for c in treatments]
    up = _upper(k)
    pairs = settled(
        df.groupBy(cluster_1, cluster_2).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(t[i] * F.col(y)).alias(f"b{i}") for i in range(k)],
            *[F.sum(t[i] * t[j]).alias(f"g{i}_{j}") for i, j in up],
        )
    )
    names = ["n", *[f"b{i}" for i in range(k)], *[f"g{i}_{j}" for i, j in up]]
    total = pairs.agg(*[F.sum(c).alias(c) for c in names]).first()
    gram = _symmetric({(i, j): total[f"g{i}_{j}"] for i, j in up}, k)
    beta, inv = solve_min_norm(gram, np.array([total[f"b{i}"] for i in range(k)]))

    def score(i: int) -> Column:
        own = [F.col(f"g{min(i, j)}_{max(i, j)}") * float(beta[j]) for j in range(k)]
        return F.col(f"b{i}") - reduce(lambda a, b: a + b, own)

    scored = pairs.select(cluster_1, cluster_2, *[score(i).alias(f"s{i}") for i in range(k)])

    def outer(clusters: DataFrame, label: str) -> DataFrame:
        return clusters.agg(
            F.count(F.lit(1)).alias("G"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in up]
        ).withColumn("by", F.lit(label))

    summed = lambda c: scored.groupBy(c).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    rows = (
        outer(summed(cluster_1), "1").unionByName(outer(summed(cluster_2), "2")).unionByName(outer(scored, "12"))
    ).collect()
    n = int(total["n"])
    v = {}
    for r in rows:
        meat = _symmetric({(i, j): r[f"m{i}_{j}"] for i, j in up}, k)
        correction = (r["G"] / (r["G"] - 1)) * ((n - 1) / (n - k))
        v[r["by"]] = correction * inv @ meat @ inv
    cov = floor_eigenvalues(v["1"] + v["2"] - v["12"])
    return LinearFit(beta, np.sqrt(np.clip(np.diag(cov), 0, None)), cov, n)


def floor_eigenvalues(v: np.ndarray) -> np.ndarray:
    """The nearest positive semi-definite matrix with the same eigenvectors."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    return vectors @ np.diag(np.maximum(values, 0.0)) @ vectors.T


# ── wide designs: Gram matrices by Arrow batch ────────────────────────────────

Design = Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {}
    for name, col in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_list(col.type):
            out[name] = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def cross_products(df: DataFrame, design: Design, width: int, targets: int, group: str | None = None) -> dict:
    """Sums X'X, X'Y, Y'Y, sum(X) and n of a design built per Arrow batch, per value of ``group``.

    Each task multiplies its batches into one small matrix per group; Spark adds the entries up and
    width x (width + targets) numbers per group reach the driver. ``design`` maps the batch columns
    to (X, Y, weights or None).
    """
    size = width + targets

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = _columns(batch)
            x, y, weight = design(cols)
            z = np.column_stack([x, y, np.ones(len(x))])
            left = z if weight is None else z * weight[:, None]
            groups = cols[group] if group else np.zeros(len(x), dtype=np.int64)
            for g in np.unique(groups):
                at = groups == g
                part = left[at].T @ z[at]
                sums[int(g)] = sums[int(g)] + part if int(g) in sums else part
        rows = [(g, i, m[i].tolist()) for g, m in sums.items() for i in range(size + 1)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.list_(pa.float64())),
            ],
            names=["g", "i", "row"],
        )

    summed = (
        df.mapInArrow(partials, "g bigint, i int, row array<double>")
        .select("g", "i", F.posexplode("row").alias("j", "v"))
        .groupBy("g", "i", "j")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    out: dict[int, np.ndarray] = {}
    for r in summed:
        out.setdefault(r["g"], np.zeros((size + 1, size + 1)))[r["i"], r["j"]] = r["v"]
    return out


# ── tall-skinny QR: triangular factors merged in a tree ───────────────────────

#: Factors that one merge stacks.
FAN = 32
_FACTOR = "g bigint, part bigint, n bigint, factor binary"


def _reduced(stack: np.ndarray) -> np.ndarray:
    """The triangular factor of a stack, square."""
    size = stack.shape[1]
    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((size - len(r), size))]) if len(r) < size else r


def _merged(size: int):
    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        rows = sorted(zip(parts.column("part").to_pylist(), parts.column("factor").to_pylist(), strict=True))
        stack = np.vstack([np.frombuffer(f, np.float64).reshape(size, size) for _, f in rows])
        n = sum(parts.column("n").to_pylist())
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "factor": pa.array([_reduced(stack).tobytes()], pa.binary())})

    return merge


def triangular_factors(df: DataFrame, design: Design, width: int, targets: int, group: str | None = None, fan: int = FAN) -> dict[int, tuple[np.ndarray, int]]:
    """R of the design's [X Y] and its rows, per value of ``group``.

    A task folds its batches into one factor per group; factors are stacked and factored again ``fan`` at a time until
    each group has one, so neither a task nor the driver holds more than ``fan`` of them at once.
    """
    size = width + targets

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = _columns(batch)
            x, y, _ = design(cols)
            z = np.column_stack([x, y]).astype(np.float64)
            groups = cols[group] if group else np.zeros(len(z), dtype=np.int64)
            for g in np.unique(groups).tolist():
                at = groups == g
                r, n = held.get(g, (np.zeros((0, size)), 0))
                held[g] = _reduced(np.vstack([r, z[at]])), n + int(at.sum())
        part = TaskContext.get().partitionId()
        rows = sorted(held.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([g for g, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()),
                pa.array([n for _, (_, n) in rows], pa.int64()), pa.array([r.tobytes() for _, (r, _) in rows], pa.binary()),
            ],
            names=["g", "part", "n", "factor"],
        )

    factors = settled(df.mapInArrow(factored, _FACTOR), "factors")
    most = factors.agg(F.max("part")).first()[0]
    while most:
        at = F.floor(F.col("part") / fan)
        factors, most = settled(factors.withColumn("to", at).groupBy("g", "to").applyInArrow(_merged(size), _FACTOR), "factors"), most // fan
    return {r["g"]: (np.frombuffer(r["factor"], np.float64).reshape(size, size), r["n"]) for r in factors.collect()}


def solve_triangular(factor: np.ndarray, width: int, rcond: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-norm coefficients, a column per target, and the pseudo-inverse of X'X; columns are scaled to length 1 before."""
    r, rhs = factor[:, :width], factor[:, width:]
    scale = np.sqrt((r * r).sum(0))
    scale = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0.0)
    inverse = np.linalg.pinv(r * scale, rcond=rcond) * scale[:, None]
    return inverse @ rhs, inverse @ inverse.T


def merged_factors(factors: list[np.ndarray], size: int) -> np.ndarray:
    return _reduced(np.vstack([np.zeros((0, size)), *factors]))
