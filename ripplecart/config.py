"""Column names, study settings and session settings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

STORE, PRODUCT, WEEK = "STORE_ID", "PRODUCT_ID", "WEEK_NO"
CELL = [STORE, PRODUCT, WEEK]
HIERARCHY = ["DEPARTMENT", "COMMODITY_DESC", "SUB_COMMODITY_DESC", "BRAND"]

SUB, COMP = "sub", "comp"
EFFECTS = ("direct", "sub_spillover", "comp_spillover")
SPILLOVER_FEATURES = [
    "n_treated_substitutes",
    "frac_treated_substitutes",
    "avg_units_substitutes",
    "n_treated_complements",
    "frac_treated_complements",
    "avg_units_complements",
]


@dataclass(frozen=True)
class StudyConfig:
    """Defaults of a study; every operator also takes its settings as plain arguments."""

    treatment: str = "promo_any"
    treatment_continuous: str = "discount_rate"
    outcome: str = "units_sold"
    train_weeks: tuple[int, int] = (1, 70)
    val_weeks: tuple[int, int] = (71, 85)
    test_weeks: tuple[int, int] = (86, 102)
    embedding_dim: int = 64
    weight_types: tuple[str, ...] = ("binary", "edge_weight")
    min_cooccurrence: int = 10
    max_neighbors: int = 50
    n_folds: int = 5
    confidence_level: float = 0.95
    log_transform: bool = True
    min_demand: float = 0.01
    include_discount_rate: bool = False
    true_direct_effect: float = 0.10
    true_sub_spillover: float = -0.05
    true_comp_spillover: float = 0.03
    noise_std: float = 0.5
    confounding_strength: float = 0.5
    baseline_demand: float = 1.5
    seed: int = 42


#: Bytes of a file or of shuffled rows that a task reads. Compressed lines and pairs take some 10 bytes in a file and 150 in a
#: hash table or sort, so a task of Spark's default 64 to 128 MB holds gigabytes.
TASK_BYTES = 8 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", text.strip().lower()).groups()
    return int(number) * _UNITS[unit[:1]]


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the plans rely on; all are runtime settings, results do not depend on them.

    The panel and exposure joins are laid out on a subset of their join keys, (store, product) or
    (store, week), so that one exchange serves several joins; Spark reuses such a layout only when
    it may co-partition on part of the keys. A task reads up to TASK_BYTES, so larger tables make more tasks, not larger ones.
    """
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if _bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, f"{TASK_BYTES}b")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def spread_shuffles(spark: SparkSession, parts: int) -> None:
    """Shuffles start with at least this many parts; adaptive execution joins those that turn out small."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(key, max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is configured, a folder in the warehouse, which is shared as well."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured
