"""Known-truth metrics, refutation checks and the semi-synthetic outcome."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplecart.config import CELL, STORE, WEEK, StudyConfig
from ripplecart.functions.distributed import broadcast_if_small, global_rank, permuted_columns
from ripplecart.functions.scalars import hash_uniform, normal_draw, standardised
from ripplecart.operators.exposure import add_exposures

Estimator = Callable[[DataFrame], DataFrame]

EXPECTED_SIGNS = {"direct": "positive", "sub_spillover": "negative", "comp_spillover": "positive"}


def _metrics():
    err = F.col("estimate") - F.col("true_value")
    covers = (F.col("ci_lower") <= F.col("true_value")) & (F.col("true_value") <= F.col("ci_upper"))
    return {
        "mean_bias": F.avg(err),
        "std_bias": F.stddev_samp(err),
        "rmse": F.sqrt(F.avg(err * err)),
        "coverage": F.avg(F.when(covers, 1.0).otherwise(0.0)),
        "n_sims": F.count(err),
    }


def _by_effect(sims: DataFrame, names: list[str]) -> DataFrame:
    m = _metrics()
    return sims.filter(F.col("effect").isNotNull()).groupBy("effect").agg(*[m[n].alias(n) for n in names])


def bias(sims: DataFrame) -> DataFrame:
    return _by_effect(sims, ["mean_bias", "std_bias", "n_sims"])


def rmse(sims: DataFrame) -> DataFrame:
    return _by_effect(sims, ["rmse"])


def ci_coverage(sims: DataFrame) -> DataFrame:
    """Share of intervals that contain the truth, both ends included."""
    return _by_effect(sims, ["coverage", "n_sims"])


def synthetic_evaluation(sims: DataFrame) -> DataFrame:
    """Bias, RMSE and coverage per effect in one aggregation."""
    return _by_effect(sims, ["mean_bias", "std_bias", "rmse", "coverage", "n_sims"])


def covariate_balance(panel: DataFrame, treatment: str = "promo_any", covariates: list[str] | None = None) -> DataFrame:
    """Standardised mean difference per numeric covariate, all of them in one pass.

    Covariates that are absent or not numeric are skipped. The difference is 0 when the pooled
    standard deviation is 0 or undefined; below 0.1 in magnitude is acceptable.
    """
    asked = covariates or ["discount_rate", WEEK]
    types = {f.name: f.dataType for f in panel.schema.fields}
    cols = [c for c in asked if isinstance(types.get(c), T.NumericType)]
    arm = {"t": F.col(treatment) == 1, "c": F.col(treatment) == 0}
    moments = panel.agg(
        *[f(F.when(on, F.col(c).cast("double"))).alias(f"{c}|{a}|{n}")
          for c in cols for a, on in arm.items() for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    )
    at = lambda c, a, n: F.col(f"`{c}|{a}|{n}`")
    stacked = moments.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("covariate"),
                        at(c, "t", "m").alias("treated_mean"),
                        at(c, "c", "m").alias("control_mean"),
                        F.sqrt((at(c, "t", "s") * at(c, "t", "s") + at(c, "c", "s") * at(c, "c", "s")) / 2).alias("sd"),
                    )
                    for c in cols
                ]
            )
        )
    )
    smd = F.when(F.col("sd") > 0, (F.col("treated_mean") - F.col("control_mean")) / F.col("sd")).otherwise(0.0)
    return stacked.select("covariate", "treated_mean", "control_mean", smd.alias("smd"), (F.abs(smd) < 0.1).alias("acceptable"))


def directional_check(effects: DataFrame) -> DataFrame:
    """Whether each estimate has its expected sign; any number of models or groups at once."""
    expected = F.create_map(*[F.lit(x) for kv in EXPECTED_SIGNS.items() for x in kv])[F.col("effect")]
    others = [c for c in effects.columns if c in ("model", "ablation", "group")]
    passes = F.when(expected == "positive", F.col("ATE") > 0).otherwise(F.col("ATE") < 0)
    return effects.select(
        *others, "effect", F.col("ATE").alias("estimate"), expected.alias("expected_sign"), passes.alias("passes")
    )


def placebo_test(
    panel: DataFrame,
    estimator: Estimator,
    n_permutations: int = 20,
    treatment: str = "promo_any",
    seed: int = 42,
) -> DataFrame:
    """Shuffle the treatment over all rows, re-estimate, repeat: (perm_id, effect, estimate, ci).

    All shuffled treatments come from one ranking of the rows and are saved side by side; an estimate reads its own.
    """
    table, names = permuted_columns(panel, CELL, treatment, range(n_permutations), seed=seed)
    parts = [
        estimator(table.drop(treatment).withColumnRenamed(name, treatment).select(*panel.columns)).select(
            F.lit(i).alias("perm_id"), "effect", "estimate", "ci_lower", "ci_upper"
        )
        for i, name in enumerate(names)
    ]
    return reduce(DataFrame.unionByName, parts)


def _with_store_code(panel: DataFrame) -> DataFrame:
    """``_store_code``: 0-based position of the store id among the sorted distinct ids."""
    stores = panel.select(STORE).distinct()
    ranked = global_rank(stores, F.floor(F.col(STORE) / 1024), [STORE], "_rank")
    codes, _ = broadcast_if_small(ranked.select(STORE, (F.col("_rank") - 1).cast("double").alias("_store_code")))
    return panel.join(codes, STORE)


def assign_confounded(panel: DataFrame, strength: float = 0.5, seed: int = 42, treatment: str = "promo_any") -> DataFrame:
    """Replace the treatment by a coin whose odds rise with store code and week."""
    coded = _with_store_code(panel)
    logit = strength * (
        standardised(coded, F.col("_store_code"), ddof=0) + standardised(panel, F.col(WEEK).cast("double"), ddof=1)
    )
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    u = hash_uniform(seed, "assign", *[F.col(c) for c in CELL])
    return coded.withColumn(treatment, (u < prob).cast("int")).select(*panel.columns)


def generate_outcome(
    panel: DataFrame,
    edges: DataFrame,
    config: StudyConfig | None = None,
    *,
    reassign_treatment: bool = False,
    log_space: bool = False,
) -> DataFrame:
    """Add ``y_synthetic`` with known direct and spillover effects on the real graph and treatments.

    The linear index is baseline + effects + 0.5 z(store) + 0.3 z(week) + noise; in log space the
    outcome is its exponential minus one. Outcomes below 0 become 0.
    """
    cfg = config or StudyConfig()
    if reassign_treatment:
        panel = assign_confounded(panel, cfg.confounding_strength, cfg.seed)
    exposed = add_exposures(panel, edges, "promo_any", "edge_weight")
    coded = _with_store_code(exposed)
    stats = _with_store_code(panel)
    noise = normal_draw(cfg.seed, "noise", *[F.col(c) for c in CELL]) * cfg.noise_std if cfg.noise_std else F.lit(0.0)
    linear = (
        F.lit(cfg.baseline_demand)
        + cfg.true_direct_effect * F.col("promo_any")
        + cfg.true_sub_spillover * F.col("sub_exposure_weighted")
        + cfg.true_comp_spillover * F.col("comp_exposure_weighted")
        + 0.5 * standardised(stats, F.col("_store_code"))
        + 0.3 * standardised(panel, F.col(WEEK).cast("double"))
        + noise
    )
    y = F.expm1(linear) if log_space else linear
    return coded.withColumn("y_synthetic", F.greatest(y, F.lit(0.0))).select(*exposed.columns, "y_synthetic")
