"""Profiles of the typed product graphs: size, density, degrees, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.config import PRODUCT
from ripplecart.functions.distributed import broadcast_if_small, histogram, percentiles, sample_exact


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, undirected edges, density and weight range per graph."""
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        edges.groupBy("graph")
        .agg(F.count(F.lit(1)).alias("nnz"), F.min("w").alias("w_min"), F.max("w").alias("w_max"))
        .select(
            "graph",
            n.alias("n_nodes"),
            F.floor(F.col("nnz") / 2).alias("n_edges"),
            F.coalesce(F.try_divide(F.col("nnz").cast("double"), (n * (n - 1)).cast("double")), F.lit(0.0)).alias(
                "density"
            ),
            "w_min",
            "w_max",
        )
    )


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree of every node in every graph, 0 for isolated ones: (graph, PRODUCT_ID, degree)."""
    counted = edges.groupBy("graph", F.col("src").alias(PRODUCT)).agg(F.count(F.lit(1)).alias("degree"))
    graphs = nodes.select(PRODUCT, F.explode(F.array(F.lit("sub"), F.lit("comp"))).alias("graph"))
    return graphs.join(counted, ["graph", PRODUCT], "left").na.fill(0, subset=["degree"])


def degree_distribution(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(edges, nodes).groupBy("graph", "degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def median_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return percentiles(degrees(edges, nodes), "degree", [0.5], ["graph"]).select(
        "graph", F.col("q").alias("median_degree")
    )


def weight_histogram(edges: DataFrame, graph: str, bins: int = 60) -> DataFrame:
    return histogram(edges.filter(F.col("graph") == graph), F.col("w"), bins)


def edge_label_sample(edges: DataFrame, product: DataFrame, graph: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of undirected edges with the sub-commodity of both ends."""
    once = edges.filter((F.col("graph") == graph) & (F.col("src") < F.col("dst"))).select("src", "dst", "w")
    picked = sample_exact(once, ["src", "dst"], n, seed=seed, tag="edge")
    labels, _ = broadcast_if_small(product.select(PRODUCT, "SUB_COMMODITY_DESC"))
    end = lambda side: labels.select(F.col(PRODUCT).alias(side), F.col("SUB_COMMODITY_DESC").alias(f"{side}_label"))
    return picked.join(end("src"), "src", "left").join(end("dst"), "dst", "left")


def embedding_coverage(embeddings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with a non-zero vector: count and share."""
    has = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)).cast("int")
    return nodes.join(embeddings, PRODUCT, "left").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum(has).alias("n_nonzero"), F.avg(has).alias("share_nonzero")
    )
