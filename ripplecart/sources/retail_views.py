"""Retail views over TPC-H-like tables: the study's input schemas for tests, queries and benchmarks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecart.config import CELL, PRODUCT, STORE, WEEK
from ripplecart.functions.distributed import BROADCAST_ROWS, joined_rows, settled, uneven_keys
from ripplecart.functions.scalars import digits_below, hash_digits
from ripplecart.operators.panel import aggregate_cells, dense_index, dense_parts, panel_of_cells


def cell_key() -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in CELL])


def day_number(ts: Column) -> Column:
    return F.datediff(ts, F.lit("1995-01-01").cast("date")) + 1


@dataclass(frozen=True)
class RetailViews:
    """``store``: 'region' (5 stores) or 'nation' (25); ``period_days``: length of a WEEK_NO period.

    ``catalog``: 'folded' makes a product of all parts of a brand and type (150) and takes orders as baskets; 'part' has a
    product per part, so the catalog grows with the tables, and takes what a store ships in a day as a basket: orders
    of a few lines over tens of thousands of products hold hardly a pair twice.
    """

    spark: SparkSession
    folder: str
    store: str = "region"
    period_days: int = 28
    catalog: str = "folded"
    many_orders: int = BROADCAST_ROWS

    @property
    def min_cooccurrence(self) -> int:
        return 2 if self.catalog == "part" else 10

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    def product_map(self) -> DataFrame:
        part = self.table("part")
        types = part.agg(F.array_sort(F.collect_set("p_type"))).scalar()
        brand = F.substring("p_brand", 7, 10).cast("bigint")
        if self.catalog == "part":
            return part.select("p_partkey", F.col("p_partkey").alias(PRODUCT), brand.alias("b"), "p_type", (F.col("p_size") % 5).alias("s"))
        return part.select(
            "p_partkey",
            (brand * 10 + F.array_position(types, F.col("p_type"))).alias(PRODUCT),
            brand.alias("b"),
            "p_type",
        )

    def products(self) -> DataFrame:
        b, kind = F.col("b"), F.col("p_type")
        if self.catalog == "part":
            commodity = F.concat(kind, F.lit("-C"), b.cast("string"))
            return self.product_map().select(
                PRODUCT, kind.alias("DEPARTMENT"), commodity.alias("COMMODITY_DESC"),
                F.concat(commodity, F.lit("-S"), F.col("s").cast("string")).alias("SUB_COMMODITY_DESC"),
                F.when(b <= 12, "National").otherwise("Private").alias("BRAND"),
            ).distinct()
        return (
            self.product_map()
            .select(PRODUCT, "b", "p_type")
            .distinct()
            .select(
                PRODUCT,
                kind.alias("DEPARTMENT"),
                F.concat(kind, F.lit("-C"), (b % 2).cast("string")).alias("COMMODITY_DESC"),
                F.concat(kind, F.lit("-S"), (b % 4).cast("string")).alias("SUB_COMMODITY_DESC"),
                F.when(b <= 12, "National").otherwise("Private").alias("BRAND"),
            )
        )

    @cached_property
    def uneven_orders(self) -> DataFrame:
        """Order keys of lines that no order or several have, saved."""
        return settled(uneven_keys(self.table("lineitem"), "l_orderkey", self.table("orders"), "o_orderkey"), "uneven")

    def _ordered_lines(self, households: bool) -> DataFrame:
        """Lines joined to the orders; without households, lines of many orders are not exchanged for it, only their keys."""
        lines, orders = self.table("lineitem"), self.table("orders").select("o_orderkey", "o_custkey")
        if households or orders.count() <= self.many_orders:
            return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined_rows(lines, "l_orderkey", self.uneven_orders)

    def transactions(self, households: bool = True) -> DataFrame:
        """Lines joined to the order, part and supplier dimensions; Spark picks each join by size.

        Without ``households`` the rows are the same, but have no household_key.
        """
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        if self.store == "region":
            nation = self.table("nation").select("n_nationkey", "n_regionkey")
            stores = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
                "s_suppkey", F.col("n_regionkey").cast("bigint").alias(STORE)
            )
        else:
            stores = supplier.select("s_suppkey", F.col("s_nationkey").cast("bigint").alias(STORE))
        day = day_number(F.col("l_shipdate"))
        line, tax = F.col("l_extendedprice"), F.col("l_tax")
        basket = day.cast("bigint") * 100 + F.col(STORE) if self.catalog == "part" else F.col("l_orderkey")
        return (
            self._ordered_lines(households)
            .join(self.product_map().select("p_partkey", PRODUCT), F.col("l_partkey") == F.col("p_partkey"))
            .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                *([F.col("o_custkey").alias("household_key")] if households else []),
                basket.alias("BASKET_ID"),
                day.alias("DAY"),
                (F.floor((day - 1) / self.period_days) + 1).cast("int").alias(WEEK),
                PRODUCT,
                STORE,
                F.col("l_quantity").alias("QUANTITY"),
                (line * (1 - F.col("l_discount"))).alias("SALES_VALUE"),
                (-line * F.col("l_discount")).alias("RETAIL_DISC"),
                F.when(F.col("l_returnflag") == "R", -tax).otherwise(0.0).alias("COUPON_DISC"),
                F.when(F.col("l_linestatus") == "F", -tax / 2).otherwise(0.0).alias("COUPON_MATCH_DISC"),
            )
        )

    def cells(self) -> DataFrame:
        return aggregate_cells(self.transactions(households=False))

    def causal(self, cells: DataFrame | None = None, parts: int | None = None) -> DataFrame:
        """Flag codes of about half the dense index; ``cells`` are the saved cells, where there are any."""
        key = cell_key()
        drawn = (
            dense_index(self.cells() if cells is None else cells, parts)
            .filter(digits_below(hash_digits("row", key), 0.5))
            .select(*CELL, hash_digits("d", key).alias("d"), hash_digits("m", key).alias("m"))
        )
        below = lambda name, bound: digits_below(F.col(name), bound)
        return drawn.select(
            *CELL,
            F.when(below("d", 0.02), None).when(below("d", 0.12), " A ").when(below("d", 0.20), "9").otherwise("0").alias("display"),
            F.when(below("m", 0.10), "D").otherwise(" 0").alias("mailer"),
        )

    def panel(self) -> DataFrame:
        """The panel and its flag table read the same saved cells."""
        cells = settled(self.cells(), "cells")
        parts = dense_parts(cells)
        return panel_of_cells(cells, self.causal(cells, parts), self.products(), parts)

    def embeddings(self) -> DataFrame:
        """Vectors by product, all that the catalog has."""
        vec = self.table("embeddings").select(F.col("vec_id").alias(PRODUCT), "embedding")
        return vec.join(self.products().select(PRODUCT), PRODUCT, "left_semi")

    def campaign_table(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("household_key"), (F.col("o_orderkey") % 30).cast("int").alias("CAMPAIGN")
        )

    def coupon_redempt(self) -> DataFrame:
        return (
            self.table("orders")
            .filter(F.col("o_orderpriority") == "1-URGENT")
            .select(
                F.col("o_custkey").alias("household_key"),
                day_number(F.col("o_orderdate")).alias("DAY"),
                (F.col("o_orderkey") % 500).alias("COUPON_UPC"),
            )
        )

    def hh_demographic(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("household_key"), F.col("c_mktsegment").alias("INCOME_DESC")
        )

    def campaigns(self) -> DataFrame:
        days = {"START_DAY": F.min("day").cast("int"), "END_DAY": F.max("day").cast("int")}
        orders = self.table("orders").select((F.col("o_orderkey") % 30).cast("int").alias("CAMPAIGN"), day_number(F.col("o_orderdate")).alias("day"))
        return orders.groupBy("CAMPAIGN").agg(*[c.alias(n) for n, c in days.items()])

    def tables(self) -> dict[str, DataFrame]:
        return {
            "transactions": self.transactions(),
            "causal": self.causal(),
            "products": self.products(),
            "campaign_hh": self.campaign_table(),
            "redemptions": self.coupon_redempt(),
            "demographics": self.hh_demographic(),
            "campaigns": self.campaigns(),
            "coupons": self.coupon_redempt().select("COUPON_UPC").distinct(),
        }

    def simulation_results(self) -> DataFrame:
        """Simulated estimates by effect, in the shape the evaluation metrics read."""
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("sim_id"),
            F.when(flag == "A", "direct").when(flag == "N", "sub_spillover").otherwise("comp_spillover").alias("effect"),
            F.lit(0.05).alias("true_value"),
            F.col("l_discount").alias("estimate"),
            (F.col("l_discount") - F.col("l_tax")).alias("ci_lower"),
            (F.col("l_discount") + F.col("l_tax")).alias("ci_upper"),
        )
