"""Decomposition of per-row effects by group and product, and readable effect tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.config import EFFECTS, PRODUCT

# Captions of the three effects.
EFFECT_LABELS = {
    "direct": ("Direct (own promo)", "Units gained from own promotion"),
    "sub_spillover": ("Substitute spillover", "Cannibalization: demand loss when substitutes promoted"),
    "comp_spillover": ("Complement spillover", "Attachment lift: demand gain when complements promoted"),
}


def cate_by_group(cate: DataFrame, group: str = "DEPARTMENT") -> DataFrame:
    """Mean and standard deviation of each effect per group, most negative substitute effect first."""
    return (
        cate.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.avg("direct_cate").alias("direct_mean"),
            F.stddev_samp("direct_cate").alias("direct_std"),
            F.avg("sub_spillover_cate").alias("sub_spill_mean"),
            F.stddev_samp("sub_spillover_cate").alias("sub_spill_std"),
            F.avg("comp_spillover_cate").alias("comp_spill_mean"),
            F.stddev_samp("comp_spillover_cate").alias("comp_spill_std"),
            F.count("direct_cate").alias("n_obs"),
        )
        .orderBy("sub_spill_mean", group)
    )


def cannibalised_groups(cate: DataFrame, group: str = "DEPARTMENT") -> DataFrame:
    """Groups with a negative mean substitute effect."""
    summary = cate_by_group(cate, group).filter(F.col("sub_spill_mean") < 0)
    return summary.select(group, "sub_spill_mean", "sub_spill_std", "direct_mean", "n_obs").orderBy(
        "sub_spill_mean", group
    )


def top_spillover_products(cate: DataFrame, effect: str = "sub_spillover", top_k: int = 20) -> DataFrame:
    """Products with the largest mean effect in magnitude, ties by id."""
    if effect not in EFFECTS:
        raise ValueError(f"effect must be one of {EFFECTS}, got {effect!r}")
    c = f"{effect}_cate"
    return (
        cate.groupBy(PRODUCT)
        .agg(F.avg(c).alias("cate_mean"), F.stddev_samp(c).alias("cate_std"), F.count(c).alias("n_obs"))
        .orderBy(F.abs("cate_mean").desc(), PRODUCT)
        .limit(top_k)
    )


def cate_spread(cate: DataFrame, column: str) -> DataFrame:
    return cate.agg(
        F.min(column).alias("cate_min"), F.max(column).alias("cate_max"), F.stddev_pop(column).alias("cate_std")
    )


def compare_effects(effects: DataFrame) -> DataFrame:
    """The three effects of a model with captions."""
    pick = lambda i: F.create_map(*[F.lit(x) for e, v in EFFECT_LABELS.items() for x in (e, v[i])])[F.col("effect")]
    return effects.select(
        pick(0).alias("effect"), "ATE", "CI_lower", "CI_upper", pick(1).alias("interpretation")
    )


def compare_models(baselines: DataFrame, graph_effects: DataFrame) -> DataFrame:
    """Direct effects of the baselines next to the graph model's."""
    cols = ["model", "ATE", "CI_lower", "CI_upper"]
    graph = graph_effects.filter(F.col("effect") == "direct").select(*cols, F.lit("graph").alias("source"))
    return baselines.select(*cols, F.lit("baseline").alias("source")).unionByName(graph)
