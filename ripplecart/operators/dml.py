"""Double ML on graph exposures: direct effect, substitute and complement spillover."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecart.config import CELL, EFFECTS, HIERARCHY, PRODUCT, STORE
from ripplecart.functions.distributed import settled
from ripplecart.operators.covariates import Covariates, covariates, with_group_folds
from ripplecart.operators.exposure import add_exposures
from ripplecart.operators.linear import LinearFit, clustered_ols, cross_products, solve_triangular, triangular_factors
from ripplecart.operators.nuisance import Nuisance, residualise
from ripplecart.operators.panel import demand_filter
from ripplecart.sources.stores import RESULT_SCHEMA, stack_results

TREATMENTS = ["t_direct", "t_sub", "t_comp"]
CATE_COLUMNS = [f"{e}_cate" for e in EFFECTS]


def effects_table(spark: SparkSession, model: str, effects: list[str], fit: LinearFit, level: float) -> DataFrame:
    """Tidy rows (model, effect, ATE, se, CI_lower, CI_upper, n_obs)."""
    lower, upper = fit.interval(level)
    rows = [
        (model, e, float(fit.beta[i]), float(fit.se[i]), float(lower[i]), float(upper[i]), fit.n)
        for i, e in enumerate(effects)
    ]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


@dataclass(frozen=True)
class LinearCate:
    """Effects linear in the covariates: theta[j] = (mean effect, slope per standardised covariate)."""

    theta: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    cov_mean: np.ndarray | None
    n: int

    def column(self, j: int) -> Column:
        """The effect of treatment j on a row as an expression of its covariate vector ``w``."""
        slopes = self.theta[j, 1:] / self.std
        const = float(self.theta[j, 0] - slopes @ self.mean)
        products = F.zip_with("w", F.array(*[F.lit(float(s)) for s in slopes]), lambda x, b: x * b)
        return F.aggregate(products, F.lit(const), lambda s, v: s + v)

    def mean_effects(self) -> LinearFit:
        """Mean effect per treatment: covariates are centred, so it is the first entry of theta."""
        se = np.sqrt(np.clip(np.diag(self.cov_mean), 0, None))
        return LinearFit(self.theta[:, 0], se, self.cov_mean, self.n)


def fit_linear_cate(res: DataFrame, y: str, treatments: list[str], inference: bool = False) -> LinearCate:
    """Regress the outcome residual on treatment residuals x [1, w], by a distributed triangular factor.

    With ``inference`` a second pass sums the squared-residual-weighted products for HC1 errors.
    """
    vector = array_to_vector("w")
    m = res.select(Summarizer.metrics("mean", "std").summary(vector).alias("m")).select("m.mean", "m.std").first()
    mean, std = m["mean"].toArray(), m["std"].toArray()
    std = np.where(std > 0, std, 1.0)
    k, p = len(treatments), len(mean) + 1
    rows = res.select("w", y, *treatments)

    def z(c: dict[str, np.ndarray]) -> np.ndarray:
        base = np.column_stack([np.ones(len(c["w"])), (c["w"] - mean) / std])
        return np.column_stack([c[t][:, None] * base for t in treatments])

    factor, n = triangular_factors(rows, lambda c: (z(c), c[y][:, None], None), k * p, 1)[0]
    coefs, inv = solve_triangular(factor, k * p)
    theta = coefs[:, 0]
    cov_mean = None
    if inference:
        meat = cross_products(
            rows, lambda c: (z(c), c[y][:, None], (c[y] - z(c) @ theta) ** 2), k * p, 1
        )[0][: k * p, : k * p]
        cov = inv @ meat @ inv * (n / max(n - k * p, 1))
        first = np.arange(k) * p
        cov_mean = cov[np.ix_(first, first)]
    return LinearCate(theta.reshape(k, p), mean, std, cov_mean, n)


@dataclass(frozen=True)
class GraphEstimate:
    """``effects``: pooled estimates. ``residuals``: keyed rows with y, treatments and their residuals."""

    model: str
    effects: DataFrame
    residuals: DataFrame
    covariates: Covariates | None = None

    def cate(self) -> DataFrame:
        """Keyed per-row effects (direct, substitute, complement), linear in the covariates."""
        if self.covariates is None:
            raise ValueError("the model was fitted without covariates")
        res = self.covariates.attach(self.residuals)
        fit = fit_linear_cate(res, "y_res", [f"{t}_res" for t in TREATMENTS])
        return res.select(
            *CELL, *[c for c in HIERARCHY if c in res.columns],
            *[fit.column(j).alias(name) for j, name in enumerate(CATE_COLUMNS)],
        )


def estimation_frame(
    panel: DataFrame,
    edges: DataFrame,
    *,
    outcome: str = "units_sold",
    treatment: str = "promo_any",
    weight_type: str = "edge_weight",
    n_folds: int = 5,
    log_transform: bool = True,
    min_demand_filter: float | None = 1.0,
    include_discount_rate: bool = False,
    presence: DataFrame | None = None,
    denominator: str = "direct",
) -> DataFrame:
    """Saved narrow rows: keys, hierarchy, y, the three treatments and the product's fold.

    The demand filter comes before the exposures, so by default filtered products count as absent
    neighbours; pass ``presence`` to count them.
    """
    kept = demand_filter(panel, min_demand_filter, outcome)
    exposed = add_exposures(kept, edges, treatment, weight_type, presence, denominator)
    y = F.col(outcome).cast("double")
    frame = exposed.select(
        *CELL,
        *[c for c in HIERARCHY if c in panel.columns],
        *(["discount_rate"] if include_discount_rate else []),
        (F.log1p(y) if log_transform else y).alias("y"),
        F.col(treatment).cast("double").alias(TREATMENTS[0]),
        F.col("sub_exposure_weighted").alias(TREATMENTS[1]),
        F.col("comp_exposure_weighted").alias(TREATMENTS[2]),
    )
    return with_group_folds(settled(frame, "frame"), n_folds)


def _frame_covariates(
    frame: DataFrame, nuisance: Nuisance, wanted: bool, include_discount_rate: bool, embeddings: DataFrame | None
) -> Covariates | None:
    if not wanted and not nuisance.needs_covariates:
        return None
    return covariates(frame, include_discount_rate=include_discount_rate, embeddings=embeddings)


def _cross_fit(frame: DataFrame, cov: Covariates | None, targets: list[str], n_folds: int, nuisance: Nuisance) -> DataFrame:
    """Saved narrow residuals; the covariate vector exists only while the models read it."""
    rows = cov.attach(frame) if cov is not None and nuisance.needs_covariates else frame
    return settled(residualise(rows, targets, n_folds, nuisance).drop("w"), "residuals")


def run_graph_dml(
    panel: DataFrame,
    edges: DataFrame,
    *,
    n_folds: int = 5,
    nuisance: Nuisance | None = None,
    embeddings: DataFrame | None = None,
    confidence_level: float = 0.95,
    weight_type: str = "edge_weight",
    include_discount_rate: bool = False,
    with_cate: bool = True,
    **frame_options,
) -> GraphEstimate:
    """Cross-fitted estimate of the three effects with product- and store-clustered errors.

    Pooled effects come from a no-intercept regression of residuals on residuals; per-row effects
    (``.cate()``) from a separate regression linear in the covariates.
    """
    nuisance = nuisance or Nuisance()
    frame = estimation_frame(
        panel, edges, n_folds=n_folds, weight_type=weight_type, include_discount_rate=include_discount_rate, **frame_options
    )
    cov = _frame_covariates(frame, nuisance, with_cate, include_discount_rate, embeddings)
    res = _cross_fit(frame, cov, ["y", *TREATMENTS], n_folds, nuisance)
    fit = clustered_ols(res, "y_res", [f"{t}_res" for t in TREATMENTS], PRODUCT, STORE)
    model = f"graph_dml_{weight_type}"
    return GraphEstimate(model, effects_table(panel.sparkSession, model, list(EFFECTS), fit, confidence_level), res, cov)


def run_discount_dml(panel: DataFrame, edges: DataFrame, **options) -> GraphEstimate:
    """The depth of a discount as continuous treatment; it never enters its own covariates."""
    return run_graph_dml(panel, edges, treatment="discount_rate", include_discount_rate=False, **options)


def ablation_suite(
    panel: DataFrame,
    edges: DataFrame,
    embeddings: DataFrame | None = None,
    *,
    n_folds: int = 5,
    nuisance: Nuisance | None = None,
    confidence_level: float = 0.95,
    include_discount_rate: bool = False,
    **frame_options,
) -> DataFrame:
    """Five variants of the graph model, stacked; a channel that was switched off is ``excluded``.

    They share their work: a channel without edges has exposure 0 and so a residual of 0, and the
    outcome, the direct treatment, covariates and folds are those of the full model. So the weighted
    and the binary exposures are cross-fitted together as six targets, and only the variant without
    embeddings needs its own fits.
    """
    nuisance = nuisance or Nuisance()
    options = {"n_folds": n_folds, "include_discount_rate": include_discount_rate, **frame_options}
    frame = estimation_frame(panel, edges, weight_type="edge_weight", **options)
    binary = estimation_frame(panel, edges, weight_type="binary", **options).select(
        *CELL, F.col("t_sub").alias("b_sub"), F.col("t_comp").alias("b_comp")
    )
    frame = settled(frame.join(binary, CELL), "ablation")
    full_cov = _frame_covariates(frame, nuisance, False, include_discount_rate, embeddings)
    res = _cross_fit(frame, full_cov, ["y", *TREATMENTS, "b_sub", "b_comp"], n_folds, nuisance)
    plain_cov = _frame_covariates(frame, nuisance, False, include_discount_rate, None)
    res_plain = _cross_fit(frame, plain_cov, ["y", *TREATMENTS], n_folds, nuisance) if embeddings is not None else res

    direct, sub, comp = (f"{t}_res" for t in TREATMENTS)
    nothing = F.lit(0.0)
    variants = {
        "full_model": (res, F.col(sub), F.col(comp), None),
        "sub_only": (res, F.col(sub), nothing, "comp_spillover"),
        "comp_only": (res, nothing, F.col(comp), "sub_spillover"),
        "binary_weights": (res, F.col("b_sub_res"), F.col("b_comp_res"), None),
        "no_embeddings": (res_plain, F.col(sub), F.col(comp), None),
    }
    tables = {}
    for name, (rows, s, c, off) in variants.items():
        narrow = rows.select(PRODUCT, STORE, "y_res", F.col(direct), s.alias("s_res"), c.alias("c_res"))
        fit = clustered_ols(narrow, "y_res", [direct, "s_res", "c_res"], PRODUCT, STORE)
        model = "graph_dml_binary" if name == "binary_weights" else "graph_dml_edge_weight"
        effects = effects_table(panel.sparkSession, model, list(EFFECTS), fit, confidence_level)
        tables[name] = effects.withColumn("excluded", F.col("effect") == F.lit(off or ""))
    return stack_results(tables, "ablation")
