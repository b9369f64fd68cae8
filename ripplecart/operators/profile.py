"""Profiles of the raw tables and of the panel: inventories, coverage, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecart.config import CELL, PRODUCT, STORE, WEEK
from ripplecart.functions.distributed import broadcast_if_small, distinct_pairs, global_rank, percentiles, settled
from ripplecart.functions.scalars import stripped
from ripplecart.operators.panel import promo_flags

DISCOUNTS = ["RETAIL_DISC", "COUPON_DISC", "COUPON_MATCH_DISC"]


def share(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


# ── raw tables ────────────────────────────────────────────────────────────────


def schema_profile(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """One row per column: type, missing share in %, distinct values, a sample value (the smallest).

    Distinct values are the distinct (column, value) pairs of the table, counted; ``approximate`` takes a sketch instead.
    """
    parts = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.round(F.avg(F.col(f.name).isNull().cast("double")) * 100, 2).alias("null_pct"),
            (F.approx_count_distinct(f.name) if approximate else F.lit(None).cast("bigint")).alias("n_unique"),
            F.min(f.name).cast("string").alias("sample"),
        )
        for f in df.schema.fields
    ]
    rows = df.agg(F.array(*parts).alias("cols")).select(F.lit(name).alias("table_name"), F.inline("cols"))
    if not approximate:
        counts = distinct_counts(df, df.columns).withColumnRenamed("column", "column_name")
        rows = rows.drop("n_unique").join(counts, "column_name", "left").na.fill(0, subset=["n_unique"])
    return rows.select("table_name", "column_name", "dtype", "null_pct", "n_unique", "sample")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique) without null."""
    return distinct_pairs(df, columns).groupBy("column").agg(F.count("value").alias("n_unique"))


def schema_profiles(tables: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, [schema_profile(df, n, approximate) for n, df in tables.items()])


def entity_counts(tx: DataFrame, products: DataFrame) -> DataFrame:
    """Inventory (entity, value): distinct households, products, stores, weeks, baskets, labels, day range."""
    lines = {"household_key": "households", PRODUCT: "products_in_tx", STORE: "stores", WEEK: "weeks", "BASKET_ID": "baskets"}
    catalog = {PRODUCT: "products_in_catalog", "DEPARTMENT": "departments", "COMMODITY_DESC": "commodities", "SUB_COMMODITY_DESC": "sub_commodities"}
    totals = {"day_min": F.min("DAY").cast("bigint"), "day_max": F.max("DAY").cast("bigint"), "transaction_lines": F.count(F.lit(1))}
    return _inventory(tx, lines).unionByName(_as_rows(tx, totals, "entity")).unionByName(_inventory(products, catalog))


def _inventory(df: DataFrame, entities: dict[str, str]) -> DataFrame:
    """Distinct values of the columns under the names of their entities; a column without values counts 0."""
    names = df.sparkSession.createDataFrame(list(entities.items()), "column string, entity string")
    found = names.join(distinct_counts(df, list(entities)), "column", "left")
    return found.select("entity", F.coalesce("n_unique", F.lit(0)).alias("value"))


def _as_rows(df: DataFrame, values: dict[str, Column], label: str) -> DataFrame:
    """One aggregation turned into (label, value) rows."""
    wide = df.agg(*[c.alias(n) for n, c in values.items()])
    rows = [F.struct(F.lit(n).alias(label), F.col(n).alias("value")) for n in values]
    return wide.select(F.inline(F.array(*rows)))


def weekly_volume(tx: DataFrame) -> DataFrame:
    return tx.groupBy(WEEK).agg(F.count_distinct("BASKET_ID").alias("baskets"), F.count(PRODUCT).alias("lines"))


def peak_week(tx: DataFrame) -> DataFrame:
    """The first week with the most baskets."""
    return weekly_volume(tx).orderBy(F.col("baskets").desc(), WEEK).limit(1)


def priced_lines(tx: DataFrame) -> DataFrame:
    """Lines with a positive quantity and their implied unit price."""
    return tx.filter(F.col("QUANTITY") > 0).withColumn("unit_price", F.col("SALES_VALUE") / F.col("QUANTITY"))


def any_discount() -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != 0, F.lit(True)) for c in DISCOUNTS])


def discount_coverage(priced: DataFrame) -> DataFrame:
    """Share of lines per discount type."""
    values = {c: share(F.coalesce(F.col(c) != 0, F.lit(True))) for c in DISCOUNTS}
    values["any_discount"] = share(any_discount())
    return _as_rows(priced, values, "discount").withColumnRenamed("value", "share")


def describe(
    df: DataFrame, columns: list[str], probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), approximate: bool = False
) -> DataFrame:
    """count, mean, std, min, percentiles and max per column: (column_name, stat, value).

    The columns are stacked, so the number of passes does not grow with the number of columns.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    stacked = df.select(F.inline(cells))
    moments = stacked.groupBy("column_name").agg(
        F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    stats = F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in ("count", "mean", "std", "min", "max")])
    quantiles = percentiles(stacked, "v", probs, ["column_name"], approximate=approximate)
    label = F.concat(F.lit("p"), F.round(F.col("p") * 100, 0).cast("int").cast("string"))
    return moments.select("column_name", F.inline(stats)).unionByName(
        quantiles.select("column_name", label.alias("stat"), F.col("q").alias("value"))
    )


def value_counts(df: DataFrame, column: str | Column, name: str = "value", top: int | None = None) -> DataFrame:
    """Rows per value; with ``top`` the most frequent ones, ties by value."""
    c = F.col(column) if isinstance(column, str) else column
    counts = df.select(c.alias(name)).na.drop().groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.col("n").desc(), name).limit(top)


def with_department(lines: DataFrame, products: DataFrame) -> DataFrame:
    labels, _ = broadcast_if_small(products.select(PRODUCT, "DEPARTMENT"))
    return lines.join(labels, PRODUCT, "left")


def trimmed_prices(
    priced: DataFrame, products: DataFrame, top_departments: int = 10, q: float = 0.99, approximate: bool = False
) -> DataFrame:
    """Unit prices in (0, 99th percentile of the department), for the departments with most lines."""
    lines = settled(with_department(priced, products).select("DEPARTMENT", PRODUCT, "unit_price"), "prices")
    top = value_counts(lines, "DEPARTMENT", "DEPARTMENT", top_departments).select("DEPARTMENT")
    lines = lines.join(F.broadcast(top), "DEPARTMENT", "left_semi")  # at most top_departments rows
    cut = percentiles(lines, "unit_price", [q], ["DEPARTMENT"], approximate=approximate)
    cut = cut.select("DEPARTMENT", F.col("q").alias("upper"))
    return (
        lines.join(F.broadcast(cut), "DEPARTMENT")
        .filter((F.col("unit_price") > 0) & (F.col("unit_price") < F.col("upper")))
        .withColumn("log_price", F.log1p("unit_price"))
    )


def trimmed_discounts(priced: DataFrame, q: float = 0.99, approximate: bool = False) -> DataFrame:
    """Magnitudes of non-zero retail discounts below their 99th percentile."""
    sizes = priced.filter(F.col("RETAIL_DISC") != 0).select(F.abs("RETAIL_DISC").alias("size"))
    upper = percentiles(sizes, "size", [q], approximate=approximate).select("q").scalar()
    return sizes.filter(F.col("size") < upper)


def promo_coverage(causal: DataFrame) -> DataFrame:
    """Counts and shares of display, mailer, either and both; reach in products, stores and weeks."""
    d, m = F.col("display") == 1, F.col("mailer") == 1
    number = lambda c: F.sum(c.cast("bigint")).cast("double")
    values = {
        "rows": F.count(F.lit(1)).cast("double"),
        "display": number(d),
        "mailer": number(m),
        "either": number(d | m),
        "both": number(d & m),
        "display_share": share(d),
        "mailer_share": share(m),
        "either_share": share(d | m),
        "both_share": share(d & m),
        "products_promoted": F.count_distinct(F.when(d | m, F.col(PRODUCT))).cast("double"),
        "stores": F.count_distinct(STORE).cast("double"),
        "weeks": F.count_distinct(WEEK).cast("double"),
    }
    return _as_rows(promo_flags(causal), values, "metric")


def flag_code_counts(causal: DataFrame) -> DataFrame:
    """Rows per promotion code after stripping; a missing code is listed as 'nan'."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("flag"), F.coalesce(stripped(F.col(c)), F.lit("nan")).alias("code"))
            for c in ("display", "mailer")
        ]
    )
    return causal.select(F.inline(pairs)).groupBy("flag", "code").agg(F.count(F.lit(1)).alias("n"))


def campaign_reach(campaign_table: DataFrame, redemptions: DataFrame) -> DataFrame:
    """Campaigns and their households, redemptions and their reach: (metric, value)."""
    per_campaign = campaign_table.groupBy("CAMPAIGN").agg(F.count_distinct("household_key").alias("hh"))
    parts = [
        _as_rows(
            campaign_table,
            {
                "campaigns": F.count_distinct("CAMPAIGN").cast("double"),
                "households": F.count_distinct("household_key").cast("double"),
            },
            "metric",
        ),
        _as_rows(per_campaign, {"households_per_campaign": F.avg("hh")}, "metric"),
        _as_rows(
            redemptions,
            {
                "redemptions": F.count(F.lit(1)).cast("double"),
                "redeeming_households": F.count_distinct("household_key").cast("double"),
                "redeemed_coupons": F.count_distinct("COUPON_UPC").cast("double"),
                "first_day": F.min("DAY").cast("double"),
                "last_day": F.max("DAY").cast("double"),
            },
            "metric",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def coupon_overlap(priced: DataFrame, redemptions: DataFrame) -> DataFrame:
    """Lines whose household redeemed a coupon that day, and how many also had a retail discount."""
    days = redemptions.select("household_key", "DAY").distinct()
    hit = priced.join(days, ["household_key", "DAY"], "left_semi")
    disc = F.coalesce(F.col("RETAIL_DISC") != 0, F.lit(True))
    return hit.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(disc).alias("n_discounted"),
        F.coalesce(share(disc), F.lit(0.0)).alias("share_discounted"),
    )


def lines_with_flags(priced: DataFrame, causal: DataFrame) -> DataFrame:
    """Lines with the decoded flags of their cell (0 when the cell is not listed) and ``any_treatment``."""
    return _with_flags(priced, causal, (~_no_retail_discount()).cast("int"))


def _no_retail_discount() -> Column:
    return F.coalesce(F.col("RETAIL_DISC") == 0, F.lit(False))


def _with_flags(rows: DataFrame, causal: DataFrame, discounted: Column) -> DataFrame:
    flags = promo_flags(causal).select(*CELL, F.col("display").alias("display_active"), F.col("mailer").alias("mailer_active"))
    joined = rows.join(flags, CELL, "left").na.fill(0, subset=["display_active", "mailer_active"])
    flagged = (F.col("display_active") == 1) | (F.col("mailer_active") == 1)
    return joined.withColumn("any_treatment", F.greatest(discounted, flagged.cast("int")))


def treatment_of_top_products(priced: DataFrame, causal: DataFrame, top: int = 30, enough: float = 0.20) -> DataFrame:
    """Treatment shares of the products with most lines, and whether any treatment reaches ``enough``.

    Lines are counted per cell and kind (discounted or not) before they meet the flag table, so the
    join runs on cells and one aggregation yields every product; the top is taken at the end.
    """
    kinds = priced.groupBy(*CELL, (~_no_retail_discount()).cast("int").alias("discounted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    flagged = _with_flags(kinds, causal, F.col("discounted"))
    weighted = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    return (
        flagged.groupBy(PRODUCT)
        .agg(
            F.sum("n").alias("n_lines"),
            weighted("discounted").alias("pct_retail_disc"),
            weighted("display_active").alias("pct_display"),
            weighted("mailer_active").alias("pct_mailer"),
            weighted("any_treatment").alias("pct_any"),
        )
        .withColumn("enough", F.col("pct_any") >= enough)
        .orderBy(F.col("n_lines").desc(), PRODUCT)
        .limit(top)
    )


def catalog_structure(products: DataFrame) -> DataFrame:
    """Products per department and brand with their share in %: (level, label, n_products, pct)."""
    def by(c: str) -> DataFrame:
        total = products.agg(F.count(c)).scalar()
        counts = value_counts(products, c, "label")
        return counts.select(
            F.lit(c).alias("level"), "label", F.col("n").alias("n_products"), (F.col("n") * 100.0 / total).alias("pct")
        )

    return by("DEPARTMENT").unionByName(by("BRAND"))


def commodity_zipf(products: DataFrame) -> DataFrame:
    """Products per commodity with rank, log rank and log count, largest first, ties by label."""
    counts = products.na.drop(subset=["COMMODITY_DESC"]).groupBy("COMMODITY_DESC").agg(
        F.count_distinct(PRODUCT).alias("n_products")
    )
    order = [F.col("n_products").desc(), F.col("COMMODITY_DESC")]
    return (
        global_rank(counts, -F.col("n_products"), order, "rank")
        .withColumn("log_rank", F.log("rank"))
        .withColumn("log_products", F.log("n_products"))
    )


def treatment_variation(priced: DataFrame, low: float = 0.05, high: float = 0.95, min_weeks: int = 10) -> DataFrame:
    """Mean weekly share of discounted lines per product, and whether it varies enough to identify."""
    disc = F.coalesce(F.col("RETAIL_DISC") != 0, F.lit(True))
    weekly = priced.groupBy(PRODUCT, WEEK).agg(share(disc).alias("disc_rate"))
    rate, weeks = F.col("mean_disc_rate"), F.col("weeks_observed")
    return (
        weekly.groupBy(PRODUCT)
        .agg(F.avg("disc_rate").alias("mean_disc_rate"), F.count("disc_rate").alias("weeks_observed"))
        .withColumn("has_variation", rate.between(low, high) & (weeks >= min_weeks))
    )


# ── panel ─────────────────────────────────────────────────────────────────────


def panel_summary(panel: DataFrame, treatment: str = "promo_any") -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("units_sold") == 0).alias("n_zero"),
        share(F.col("units_sold") == 0).alias("zero_share"),
        F.sum(F.col(treatment).cast("bigint")).alias("n_treated"),
        F.avg(treatment).alias("treated_share"),
    )


def weekly_treatment_rate(panel: DataFrame, treatment: str = "promo_any") -> DataFrame:
    return panel.groupBy(WEEK).agg(F.avg(treatment).alias("treatment_rate"))


def split_summary(split_panel: DataFrame) -> DataFrame:
    """Rows and week range per split."""
    return (
        split_panel.filter(F.col("split").isNotNull())
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(WEEK).alias("week_min"), F.max(WEEK).alias("week_max"))
    )


def treated_neighbour_rows(featured: DataFrame) -> DataFrame:
    """Rows with at least one treated neighbour, per channel."""
    return featured.agg(
        F.count_if(F.col("n_treated_substitutes") > 0).alias("n_sub"),
        F.count_if(F.col("n_treated_complements") > 0).alias("n_comp"),
    )


def sample_diagnostics(
    before: DataFrame, after: DataFrame, outcome: str = "units_sold", treatment: str = "promo_any"
) -> DataFrame:
    """Rows before and after the demand filter, zero share and treated share: (metric, value)."""
    rows_before = {"rows_before_filter": F.count(F.lit(1)).cast("double")}
    kept = {
        "rows_after_filter": F.count(F.lit(1)).cast("double"),
        "zero_share_after_filter": share(F.col(outcome) == 0),
        "promo_share_after_filter": F.avg(treatment),
    }
    return _as_rows(before, rows_before, "metric").unionByName(_as_rows(after, kept, "metric"))


def treated_vs_control(panel: DataFrame, outcome: str = "units_sold", treatment: str = "promo_any") -> DataFrame:
    arm = F.when(F.col(treatment) == 1, "treated").otherwise("control").alias("arm")
    return panel.groupBy(arm).agg(
        F.avg(outcome).alias("mean_outcome"), F.avg(F.log1p(outcome)).alias("mean_log_outcome")
    )
