"""The store x product x week panel: aggregation, densification, flags, splits, demand filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplecart.config import CELL, HIERARCHY, PRODUCT, STORE, WEEK
from ripplecart.functions.distributed import broadcast_if_small, settled
from ripplecart.functions.scalars import discount_rate, flag_active
from ripplecart.sources.csv_tables import read_csv_table

PAIR = [STORE, PRODUCT]
#: Rows of the dense index that a task expands, and the fewest worth a task of their own.
DENSE_ROWS, FEW_ROWS = 500_000, 50_000


def aggregate_cells(tx: DataFrame) -> DataFrame:
    """Units, sales and discount per (store, product, week), with the discount rate.

    Lines with a missing key are dropped and an all-missing sum is 0. The partial sums run before
    the exchange, so a hot cell reaches it as one row per task.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return (
        tx.na.drop(subset=CELL)
        .groupBy(*CELL)
        .agg(
            total("QUANTITY").alias("units_sold"),
            total("SALES_VALUE").alias("sales_value"),
            total("RETAIL_DISC").alias("retail_disc_total"),
        )
        .withColumn("discount_rate", discount_rate(F.col("sales_value"), F.col("retail_disc_total")))
    )


def product_week_range(cells: DataFrame) -> DataFrame:
    """First and last week in which a product sold in any store."""
    return cells.groupBy(PRODUCT).agg(F.min(WEEK).alias("week_min"), F.max(WEEK).alias("week_max"))


def product_stores(cells: DataFrame) -> DataFrame:
    return cells.select(*PAIR).distinct()


def dense_parts(cells: DataFrame) -> int:
    """Tasks for the dense index of saved cells, by its number of rows: a few bytes of a pair become a row per week."""
    span = (F.max(WEEK) - F.min(WEEK) + 1).cast("bigint")
    rows = cells.groupBy(PRODUCT).agg((F.count_distinct(STORE) * span).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // DENSE_ROWS), min(tasks, -(-rows // FEW_ROWS)), 1)


def dense_index(cells: DataFrame, parts: int | None = None) -> DataFrame:
    """Every store that ever sold a product x every week of the product's range over all stores.

    Everything lies by product, in ``parts`` tasks (default: the session's shuffle partitions). The number is given,
    since adaptive execution would go by the bytes of the pairs and expand millions of rows in one task. The range is widened
    over the pair table (one row per product and store); the rows are expanded last and keep the layout: the dense
    index, the largest table of the pipeline, is never shuffled itself.
    """
    parts = parts or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = Window.partitionBy(PRODUCT)
    pairs = cells.select(*CELL).repartition(parts, PRODUCT).groupBy(*PAIR).agg(F.min(WEEK).alias("lo"), F.max(WEEK).alias("hi"))
    ranged = pairs.select(*PAIR, F.min("lo").over(across).alias("lo"), F.max("hi").over(across).alias("hi"))
    return ranged.select(*PAIR, F.explode(F.sequence("lo", "hi")).alias(WEEK))


def promo_flags(causal: DataFrame) -> DataFrame:
    """0/1 display, mailer and their union per row of the flag table."""
    flags = causal.select(*CELL, *[flag_active(F.col(c)).alias(c) for c in ("display", "mailer")])
    either = (F.col("display") == 1) | (F.col("mailer") == 1)
    return flags.withColumn("promo_any", either.cast("int"))


def build_panel(tx: DataFrame, causal: DataFrame, product: DataFrame) -> DataFrame:
    """Dense panel with measures, flags and product hierarchy, from lines; see ``panel_of_cells``."""
    return panel_of_cells(settled(aggregate_cells(tx), "cells"), causal, product)


def panel_of_cells(cells: DataFrame, causal: DataFrame, product: DataFrame, parts: int | None = None) -> DataFrame:
    """The panel from saved cells, which give the index and the measures, so the lines are read and aggregated once.

    Cells, flags and catalog are brought to the layout of the dense index, by product in ``parts`` tasks, so all joins run
    in place, as merge joins: none of these tables is of a size to be broadcast. A flag table that lies so already is not
    exchanged. Cells that sold nothing get measures 0, cells absent from the flag table flags 0.
    Duplicate flag or product keys multiply rows, as any left join does.
    """
    parts = parts or dense_parts(cells)
    catalog, _ = broadcast_if_small(product.select(PRODUCT, *HIERARCHY))
    measures = ["units_sold", "sales_value", "retail_disc_total", "discount_rate"]
    flags = ["display", "mailer", "promo_any"]
    return (
        dense_index(cells, parts)
        .join(cells.repartition(parts, PRODUCT).hint("merge"), CELL, "left")
        .na.fill(0.0, subset=measures)
        .withColumn("sold_any", (F.col("units_sold") > 0).cast("int"))
        .join(promo_flags(causal).hint("merge"), CELL, "left")
        .na.fill(0, subset=flags)
        .join(catalog, PRODUCT, "left")
        .select(
            F.col(STORE).cast("bigint"), F.col(PRODUCT).cast("bigint"), F.col(WEEK).cast("int"),
            *measures, "sold_any", *flags, *HIERARCHY,
        )
    )


def build_panel_from_csv(spark: SparkSession, transactions: str, causal: str, product: str) -> DataFrame:
    return build_panel(
        read_csv_table(spark, transactions),
        read_csv_table(spark, causal),
        read_csv_table(spark, product, [PRODUCT, *HIERARCHY]),
    )


def with_split(
    panel: DataFrame,
    train_weeks: tuple[int, int] = (1, 70),
    val_weeks: tuple[int, int] = (71, 85),
    test_weeks: tuple[int, int] = (86, 102),
) -> DataFrame:
    """Add ``split``; weeks outside all three inclusive ranges get null."""
    w = F.col(WEEK)
    split = (
        F.when(w.between(*train_weeks), "train").when(w.between(*val_weeks), "val").when(w.between(*test_weeks), "test")
    )
    return panel.withColumn("split", split)


def temporal_split(
    panel: DataFrame,
    train_weeks: tuple[int, int] = (1, 70),
    val_weeks: tuple[int, int] = (71, 85),
    test_weeks: tuple[int, int] = (86, 102),
) -> dict[str, DataFrame]:
    """One filtered panel per split; the week range reaches the scan or prunes its partitions."""
    ranges = {"train": train_weeks, "val": val_weeks, "test": test_weeks}
    return {name: panel.filter(F.col(WEEK).between(*r)) for name, r in ranges.items()}


def in_universe(df: DataFrame, products: DataFrame) -> DataFrame:
    """Keep the rows of the listed products."""
    return df.join(products.select(PRODUCT).distinct(), PRODUCT, "left_semi")


def demand_filter(panel: DataFrame, min_demand: float | None, outcome: str = "units_sold") -> DataFrame:
    """Keep products whose mean outcome reaches the threshold (level space, before any log)."""
    if min_demand is None:
        return panel
    kept = panel.groupBy(PRODUCT).agg(F.avg(outcome).alias("m")).filter(F.col("m") >= min_demand)
    keep, _ = broadcast_if_small(kept.select(PRODUCT))
    return panel.join(keep, PRODUCT, "left_semi")
