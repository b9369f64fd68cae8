"""Saved artefacts: panel, typed graphs, node embeddings (Parquet) and small result tables (CSV)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecart.config import PRODUCT, STORE, WEEK

RESULT_SCHEMA = "model STRING, effect STRING, ATE DOUBLE, se DOUBLE, CI_lower DOUBLE, CI_upper DOUBLE, n_obs BIGINT"


def write_panel(panel: DataFrame, path: str) -> None:
    """Partitioned by week, so that a temporal split reads only its own weeks."""
    (
        panel.repartition(WEEK, STORE)
        .sortWithinPartitions(WEEK, PRODUCT, STORE)
        .write.mode("overwrite")
        .partitionBy(WEEK)
        .parquet(path)
    )


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_graphs(edges: DataFrame, path: str) -> None:
    """Edge list (graph, src, dst, w), one folder per graph."""
    edges.select("graph", "src", "dst", "w").repartition("graph", "src").write.mode("overwrite").partitionBy(
        "graph"
    ).parquet(path)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src BIGINT, dst BIGINT, w DOUBLE, graph STRING").parquet(path)


def write_embeddings(nodes: DataFrame, path: str) -> None:
    """Node index and vectors: a node without a vector keeps its row with a null embedding."""
    nodes.select(PRODUCT, F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PRODUCT} BIGINT, embedding ARRAY<FLOAT>").parquet(path)


def write_result(table: DataFrame, path: str) -> None:
    """A result table of at most a few hundred rows as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_result(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_result_or(spark: SparkSession, path: str, build, schema: str = RESULT_SCHEMA) -> DataFrame:
    """A saved result table if there is one, else the freshly computed one."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return read_result(spark, path, schema) if fs.exists(hadoop_path) else build()


def stack_results(tables: dict[str, DataFrame], label: str) -> DataFrame:
    """Union of result tables with a label column."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
