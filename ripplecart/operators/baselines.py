"""Baseline estimators without graph exposure: OLS, residual forest, double ML, double ML + features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.config import CELL, HIERARCHY, SPILLOVER_FEATURES, STORE, WEEK
from ripplecart.functions.distributed import settled
from ripplecart.operators.covariates import covariates, with_label_codes, with_row_folds
from ripplecart.operators.dml import effects_table, fit_linear_cate
from ripplecart.operators.forest import ForestSettings, causal_forest
from ripplecart.operators.linear import ols_hc1, z_value
from ripplecart.operators.nuisance import Nuisance, residualise
from ripplecart.sources.stores import RESULT_SCHEMA, stack_results

DETAIL_SCHEMA = RESULT_SCHEMA + ", r_squared DOUBLE"


def ols_baseline(
    panel: DataFrame,
    outcome: str = "units_sold",
    treatment: str = "promo_any",
    confidence_level: float = 0.95,
    include_discount_rate: bool = False,
) -> DataFrame:
    """OLS of the outcome on [1, T, store, week, label codes] with HC1 errors; never embeddings."""
    coded = with_label_codes(panel)
    names = [STORE, WEEK, *[c for c in coded.columns if c.endswith("_code")]]
    if include_discount_rate:
        names.append("discount_rate")
    fit = ols_hc1(coded, F.col(outcome), [F.lit(1.0), F.col(treatment), *[F.col(c) for c in names]])
    lower, upper = fit.interval(confidence_level)
    row = ("ols_no_graph", "direct", *[float(v[1]) for v in (fit.beta, fit.se, lower, upper)], fit.n, fit.r_squared)
    return panel.sparkSession.createDataFrame([row], DETAIL_SCHEMA)


def _residuals(
    panel: DataFrame,
    outcome: str,
    treatment: str,
    n_folds: int,
    nuisance: Nuisance,
    embeddings: DataFrame | None,
    include_spillover: bool,
    include_discount_rate: bool,
    seed: int,
) -> DataFrame:
    rows = panel.withColumn("y", F.col(outcome).cast("double")).withColumn("t", F.col(treatment).cast("double"))
    extra = [c for c in ("discount_rate", *SPILLOVER_FEATURES) if c in panel.columns]
    rows = settled(rows.select(*CELL, *[c for c in HIERARCHY if c in panel.columns], *extra, "y", "t"), "frame")
    rows = with_row_folds(rows, n_folds, CELL, seed)
    cov = covariates(
        rows, include_spillover=include_spillover, include_discount_rate=include_discount_rate, embeddings=embeddings
    )
    fitted = residualise(cov.attach(rows) if nuisance.needs_covariates else rows, ["y", "t"], n_folds, nuisance)
    return cov.attach(settled(fitted.drop("w"), "residuals"))


def dml_baseline(
    panel: DataFrame,
    outcome: str = "units_sold",
    treatment: str = "promo_any",
    n_folds: int = 5,
    nuisance: Nuisance | None = None,
    embeddings: DataFrame | None = None,
    confidence_level: float = 0.95,
    seed: int = 42,
    include_discount_rate: bool = False,
    include_spillover: bool = False,
    heterogeneous: bool = True,
) -> DataFrame:
    """Mean effect of a double ML with effects linear in the covariates (or one constant effect).

    Folds are per row, not per product. With ``include_spillover`` the six spillover features are
    controls (the panel must carry them).
    """
    model = "dml_unweighted_spillover" if include_spillover else "dml_no_graph"
    res = _residuals(
        panel, outcome, treatment, n_folds, nuisance or Nuisance(), embeddings, include_spillover,
        include_discount_rate, seed,
    )
    if heterogeneous:
        fit = fit_linear_cate(res, "y_res", ["t_res"], inference=True).mean_effects()
    else:
        fit = ols_hc1(res, F.col("y_res"), [F.col("t_res")])
    return effects_table(panel.sparkSession, model, ["direct"], fit, confidence_level)


def forest_baseline(
    panel: DataFrame,
    outcome: str = "units_sold",
    treatment: str = "promo_any",
    n_folds: int = 5,
    nuisance: Nuisance | None = None,
    trees: int = 200,
    depth: int = 8,
    embeddings: DataFrame | None = None,
    confidence_level: float = 0.95,
    seed: int = 42,
    include_discount_rate: bool = False,
    settings: ForestSettings | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(effects, keyed CATE with errors) of the honest causal forest.

    The estimate is the mean effect; its error is the root mean square of the rows' errors, which bounds the error of
    the mean whatever the correlation between rows.
    """
    res = _residuals(
        panel, outcome, treatment, n_folds, nuisance or Nuisance(), embeddings, False, include_discount_rate, seed
    )
    settings = settings or ForestSettings(trees=trees, depth=depth, seed=seed)
    scored = settled(causal_forest(res, CELL, settings), "forest")
    m = scored.agg(
        F.avg("cate").alias("ate"), F.sqrt(F.avg(F.col("cate_se") * F.col("cate_se"))).alias("se"), F.count(F.lit(1)).alias("n")
    ).first()
    z = z_value(confidence_level)
    row = ("causal_forest_no_graph", "direct", m["ate"], m["se"], float(m["ate"] - z * m["se"]), float(m["ate"] + z * m["se"]), m["n"])
    return panel.sparkSession.createDataFrame([row], RESULT_SCHEMA), scored.select(*CELL, "cate", "cate_se")


def run_all_baselines(
    panel: DataFrame,
    outcome: str = "units_sold",
    treatment: str = "promo_any",
    n_folds: int = 5,
    nuisance: Nuisance | None = None,
    embeddings: DataFrame | None = None,
    confidence_level: float = 0.95,
    seed: int = 42,
    include_discount_rate: bool = False,
    forest_trees: int = 200,
    forest_depth: int = 8,
) -> DataFrame:
    """All four baselines as one table, each over every row.

    The last baseline needs the spillover features in the panel.
    """
    panel = settled(panel)
    common = {
        "outcome": outcome, "treatment": treatment, "confidence_level": confidence_level,
        "include_discount_rate": include_discount_rate,
    }
    ml = {**common, "n_folds": n_folds, "nuisance": nuisance, "embeddings": embeddings, "seed": seed}
    tables = {
        "B1": ols_baseline(panel, **common),
        "B2": forest_baseline(panel, **ml, trees=forest_trees, depth=forest_depth)[0],
        "B3": dml_baseline(panel, **ml),
        "B4": dml_baseline(panel, **ml, include_spillover=True),
    }
    return stack_results(tables, "baseline")
