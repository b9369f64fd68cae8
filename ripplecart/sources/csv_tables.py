"""The eight raw CSV tables, read with explicit schemas (no inference pass)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File names, column names and roles of the raw tables.
RAW_FILES = {
    "transactions": "transaction_data.csv",
    "causal": "causal_data.csv",
    "products": "product.csv",
    "campaigns": "campaign_desc.csv",
    "campaign_hh": "campaign_table.csv",
    "coupons": "coupon.csv",
    "redemptions": "coupon_redempt.csv",
    "demographics": "hh_demographic.csv",
}

# The promotion flags are codes, not numbers: as DOUBLE a '0' would print as '0.0' and count as active.
RAW_TYPES = {
    "household_key": "BIGINT",
    "BASKET_ID": "BIGINT",
    "DAY": "INT",
    "WEEK_NO": "INT",
    "PRODUCT_ID": "BIGINT",
    "STORE_ID": "BIGINT",
    "QUANTITY": "DOUBLE",
    "SALES_VALUE": "DOUBLE",
    "RETAIL_DISC": "DOUBLE",
    "COUPON_DISC": "DOUBLE",
    "COUPON_MATCH_DISC": "DOUBLE",
    "CAMPAIGN": "INT",
    "START_DAY": "INT",
    "END_DAY": "INT",
    "COUPON_UPC": "BIGINT",
}


def read_csv_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, mode: str = "FAILFAST"
) -> DataFrame:
    """Read one raw CSV: header names stripped, known columns typed, everything else STRING.

    A malformed number in a column that is read ends the job with an error that shows the line;
    ``mode="PERMISSIVE"`` makes the value null, ``mode="DROPMALFORMED"`` leaves the line out. Only the
    header line is looked at to learn the column order; Spark prunes unread columns while parsing, so
    ``columns`` costs no more than those columns.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = [h.strip() for h in header]
    schema = ", ".join(f"`{n}` {RAW_TYPES.get(n, 'STRING')}" for n in names)
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", mode).csv(path)
    return df.select(*columns) if columns else df


def read_raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv_table(spark, f"{folder.rstrip('/')}/{file}") for name, file in RAW_FILES.items()}


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table: (table_name, n_rows, n_cols)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
