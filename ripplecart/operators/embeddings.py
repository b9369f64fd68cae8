"""Node embeddings from random walks, and their two-dimensional projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.config import PRODUCT
from ripplecart.functions.distributed import settled
from ripplecart.operators.skipgram import BLOCK_NODES, BUCKET_PAIRS, SkipGramSettings, train_skip_gram
from ripplecart.operators.walks import biased_walks, unbiased_walks

def train_node_embeddings(
    edges: DataFrame,
    nodes: DataFrame,
    dim: int = 64,
    num_walks: int = 10,
    walk_length: int = 80,
    p: float = 1.0,
    q: float = 1.0,
    seed: int = 42,
    block_nodes: int = BLOCK_NODES,
    bucket_pairs: int = BUCKET_PAIRS,
) -> DataFrame:
    """One row per node, isolated ones included: their walk is the node itself."""
    if p == 1.0 and q == 1.0:
        walks = unbiased_walks(edges, nodes, num_walks, walk_length, seed)
    else:
        walks = biased_walks(edges, nodes, num_walks, walk_length, p, q, seed)
    walks = settled(walks.select("walk"), "walks")
    trained = train_skip_gram(walks, SkipGramSettings(dim=dim, seed=seed), block_nodes=block_nodes, bucket_pairs=bucket_pairs)
    return nodes.select(PRODUCT).distinct().join(trained.vectors, PRODUCT, "left")


def pca_projection(embeddings: DataFrame, product: DataFrame, top_departments: int = 10) -> DataFrame:
    """Two principal components of the normalised vectors with the product's department.

    Departments outside the most frequent ones are labelled null. The sign of a component is fixed
    by its largest loading; the explained variance shares are constant columns.
    """
    trained = embeddings.filter(F.exists("embedding", lambda x: x != 0)).select(
        PRODUCT, array_to_vector(F.col("embedding").cast("array<double>")).alias("raw")
    )
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(trained)
    model = PCA(k=2, inputCol="unit", outputCol="pc").fit(unit)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    share = [float(x) for x in model.explainedVariance]
    meta = product.select(PRODUCT, "DEPARTMENT").distinct()
    scored = (
        model.transform(unit)
        .select(PRODUCT, vector_to_array("pc").alias("pc"))
        .join(meta, PRODUCT, "left")
        .na.fill("UNKNOWN", subset=["DEPARTMENT"])
    )
    top = (
        scored.groupBy("DEPARTMENT").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "DEPARTMENT")
        .limit(top_departments)
        .select("DEPARTMENT", F.col("DEPARTMENT").alias("label"))
    )
    return scored.join(top, "DEPARTMENT", "left").select(
        PRODUCT, "label",
        (F.col("pc")[0] * signs[0]).alias("pc1"), (F.col("pc")[1] * signs[1]).alias("pc2"),
        F.lit(share[0]).alias("explained_1"), F.lit(share[1]).alias("explained_2"),
    )
