"""Cross-fitted nuisance models and the residuals of a double-ML design."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplecart.config import WEEK
from ripplecart.functions.distributed import broadcast_if_small
from ripplecart.operators.boosting import BoostSettings, boosted_predictions, residual_columns
from ripplecart.operators.linear import merged_factors, solve_triangular, triangular_factors


@dataclass(frozen=True)
class Nuisance:
    """Which model predicts outcome and treatments out of fold.

    kind: 'cell_mean' (department-week means), 'linear', 'gbt' or 'rf'. Trees, depth, step, leaves and
    the least rows of a leaf follow the study's boosted-tree setting. Boosted fits grow together
    (``operators.boosting``); ``parallel`` forest fits run at once from driver threads.
    """

    kind: str = "gbt"
    trees: int = 200
    depth: int = 6
    step: float = 0.1
    leaves: int = 31
    least_rows: int = 20
    cells: tuple[str, ...] = ("DEPARTMENT", WEEK)
    parallel: int = 4
    seed: int = 42

    @property
    def needs_covariates(self) -> bool:
        return self.kind != "cell_mean"


def residualise(df: DataFrame, targets: list[str], n_folds: int, nuisance: Nuisance) -> DataFrame:
    """Add ``<target>_res`` = target minus its out-of-fold prediction. ``df`` has ``fold`` and ``w``."""
    if nuisance.kind == "cell_mean":
        return _cell_mean_residuals(df, targets, list(nuisance.cells))
    if nuisance.kind == "linear":
        return _linear_residuals(df, targets, n_folds)
    if nuisance.kind == "gbt":
        settings = BoostSettings(nuisance.trees, nuisance.depth, nuisance.leaves, nuisance.step, nuisance.least_rows)
        return boosted_predictions(df, targets, n_folds, settings).select(*[c for c in df.columns if c != "w"], *residual_columns(targets))
    if nuisance.kind == "rf":
        return _tree_residuals(df, targets, n_folds, nuisance)
    raise ValueError(f"unknown nuisance model {nuisance.kind!r}")


def _cell_mean_residuals(df: DataFrame, targets: list[str], cells: list[str]) -> DataFrame:
    """Out-of-fold group means: a cell's totals minus the row's own fold.

    The rows are aggregated once, to (cell, fold); cell totals, global totals and fold totals come
    from that small table. A cell with no row outside the fold falls back to the global mean.
    """
    per_fold, small = broadcast_if_small(
        df.groupBy(*cells, "fold").agg(
            F.count(F.lit(1)).alias("n_cf"), *[F.sum(F.col(t).cast("double")).alias(f"{t}_cf") for t in targets]
        )
    )
    by_fold = per_fold.groupBy("fold").agg(
        F.sum("n_cf").alias("n_f"), *[F.sum(f"{t}_cf").alias(f"{t}_f") for t in targets]
    )
    everything = per_fold.agg(
        F.struct(F.sum("n_cf").alias("n"), *[F.sum(f"{t}_cf").alias(t) for t in targets]).alias("all")
    ).scalar()
    cell = Window.partitionBy(*cells)  # at most one row per fold
    n_out = F.col("n_c") - F.col("n_cf")
    means = (
        per_fold.withColumns(
            {"n_c": F.sum("n_cf").over(cell), **{f"{t}_c": F.sum(f"{t}_cf").over(cell) for t in targets}}
        )
        .join(by_fold, "fold")
        .select(
            *cells,
            "fold",
            *[
                F.when(n_out > 0, (F.col(f"{t}_c") - F.col(f"{t}_cf")) / n_out)
                .otherwise((everything[t] - F.col(f"{t}_f")) / (everything["n"] - F.col("n_f")))
                .alias(f"{t}_hat")
                for t in targets
            ],
        )
    )
    keys = [*cells, "fold"]
    marked = means.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[f"{t}_hat" for t in targets])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    joined = df.join(F.broadcast(marked) if small else marked, same, "left")
    return joined.select(
        *df.columns, *[(F.col(t).cast("double") - F.col(f"{t}_hat")).alias(f"{t}_res") for t in targets]
    )


def _linear_residuals(df: DataFrame, targets: list[str], n_folds: int) -> DataFrame:
    """Least squares on [1, w] for all folds and targets from one pass.

    The rows give a triangular factor per fold; a fit stacks those of the other folds, so K fits cost one scan.
    """
    width = _vector_width(df) + 1
    rows = df.select("fold", "w", *[F.col(t).cast("double").alias(t) for t in targets])

    def design(c: dict[str, np.ndarray]):
        return np.column_stack([np.ones(len(c["w"])), c["w"]]), np.column_stack([c[t] for t in targets]), None

    per_fold = triangular_factors(rows, design, width, len(targets), "fold")
    coefs = []
    for f in range(n_folds):
        others = merged_factors([r for g, (r, _) in sorted(per_fold.items()) if g != f], width + len(targets))
        coefs.append(solve_triangular(others, width)[0].T)

    def predicted(i: int):
        by_fold = F.array(*[F.array(*[F.lit(float(b)) for b in coefs[f][i]]) for f in range(n_folds)])
        beta = F.element_at(by_fold, F.col("fold") + 1)
        products = F.zip_with(F.concat(F.array(F.lit(1.0)), F.col("w")), beta, lambda x, b: x * b)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return df.select("*", *[(F.col(t).cast("double") - predicted(i)).alias(f"{t}_res") for i, t in enumerate(targets)])


def _vector_width(df: DataFrame) -> int:
    row = df.select(F.size("w").alias("k")).first()
    if row is None:
        raise ValueError("no rows to fit on")
    return int(row["k"])


def _tree_residuals(df: DataFrame, targets: list[str], n_folds: int, nuisance: Nuisance) -> DataFrame:
    """One MLlib forest per fold and target, fitted on the other folds.

    ``df`` should rest on a saved table. Every fold's rows are scored by that fold's models and the folds are
    put together again by a union.
    """
    rows = df.withColumn("_features", array_to_vector("w"))

    def fit(job: tuple[int, str]):
        fold, target = job
        train = rows.filter(F.col("fold") != fold).select("_features", F.col(target).cast("double").alias("label"))
        common = {
            "featuresCol": "_features", "labelCol": "label", "predictionCol": f"{target}_hat",
            "maxDepth": nuisance.depth, "seed": nuisance.seed, "maxMemoryInMB": 1024,
        }
        return RandomForestRegressor(numTrees=nuisance.trees, **common).fit(train)

    jobs = [(f, t) for f in range(n_folds) for t in targets]
    with ThreadPoolExecutor(nuisance.parallel) as pool:
        models = dict(zip(jobs, pool.map(fit, jobs), strict=True))
    parts = []
    for fold in range(n_folds):
        part = rows.filter(F.col("fold") == fold)
        for t in targets:
            part = models[(fold, t)].transform(part)
        parts.append(part)
    scored = reduce(DataFrame.unionByName, parts)
    return scored.select(
        *df.columns, *[(F.col(t).cast("double") - F.col(f"{t}_hat")).alias(f"{t}_res") for t in targets]
    )
