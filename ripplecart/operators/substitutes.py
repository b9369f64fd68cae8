"""Substitute graph: products of one sub-commodity, top-k by cosine of their embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplecart.config import PRODUCT, SUB
from ripplecart.functions.distributed import block_pairs, broadcast_if_small, settled
from ripplecart.functions.scalars import l2_normalised
from ripplecart.operators.panel import in_universe

GROUP = "SUB_COMMODITY_DESC"
BLOCK = 1024
#: Rows that a task makes out of a list of sources.
MADE_ROWS = 500_000


def catalog_nodes(product: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """(product, sub-commodity) without missing labels; a blank label is a label like any other."""
    nodes = product.select(PRODUCT, GROUP).na.drop(subset=[GROUP])
    return nodes if products is None else in_universe(nodes, products)


def _first_others(sources: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """For each source the k candidates of its group with the smallest ids, itself excluded.

    Only the first k + 1 ids of a group can be among them, so a group of n products yields n * k
    pairs at most and the window keeps k + 1 rows per group from the start. A source becomes k rows, so the sources are
    dealt out by the rows to be made, whatever their group; without a broadcast, by group.
    """
    by_id = Window.partitionBy(GROUP).orderBy(PRODUCT)
    first = (
        candidates.withColumn("_r", F.row_number().over(by_id))
        .filter(F.col("_r") <= k + 1)
        .select(GROUP, F.col(PRODUCT).alias("dst"), "_r")
    )
    heads, small = broadcast_if_small(first)
    # the source itself takes a slot away from later ids only if it is a candidate too
    own = heads.select(F.col("dst").alias("src"), GROUP, F.col("_r").alias("_own"))
    src = sources.select(F.col(PRODUCT).alias("src"), GROUP).join(own, ["src", GROUP], "left")
    parts = max(-(-sources.count() * k // MADE_ROWS), 1)
    src = src.repartition(parts, "src" if small else GROUP)
    place = F.col("_r") - F.when(F.col("_own") < F.col("_r"), 1).otherwise(0)
    return (
        src.join(heads if small else heads.repartition(parts, GROUP), GROUP)
        .filter((F.col("src") != F.col("dst")) & (place <= k))
        .select("src", "dst", F.lit(1.0).alias("w"))
    )


def _best_of_block_pairs(k: int):
    """Top-k cosines between two blocks of unit vectors, for the rows of either block."""

    def best(ids: np.ndarray, others: np.ndarray, sim: np.ndarray) -> pd.DataFrame:
        order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        w = np.take_along_axis(sim, order, axis=1)
        keep = w > 0
        src = np.broadcast_to(ids[:, None], order.shape)
        return pd.DataFrame({"src": src[keep], "dst": others[order][keep], "w": w[keep]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for left_ids, left, right_ids, right in zip(pdf.a_ids, pdf.a_vecs, pdf.b_ids, pdf.b_vecs, strict=True):
                left_ids, right_ids = np.asarray(left_ids), np.asarray(right_ids)
                a = np.asarray(left).reshape(len(left_ids), -1)
                b = np.asarray(right).reshape(len(right_ids), -1)
                sim = a @ b.T
                sim[left_ids[:, None] == right_ids[None, :]] = 0.0
                yield best(left_ids, right_ids, sim)
                if left_ids[0] != right_ids[0]:
                    yield best(right_ids, left_ids, sim.T)

    return run


def _nearest_by_cosine(nodes: DataFrame, k: int, block: int) -> DataFrame:
    """Per source the k best positive cosines within its group, exact, as block products.

    Each pair of blocks is multiplied as two matrices and reduced to k rows per product at once, so
    product pairs are never materialised and a hot group spreads over many tasks.
    """
    return block_pairs(nodes, GROUP, PRODUCT, "unit", block).mapInPandas(
        _best_of_block_pairs(k), "src bigint, dst bigint, w double"
    )


def top_neighbours(scored: DataFrame, k: int) -> DataFrame:
    """The k best (src, dst, w) per source; ties go to the smaller dst."""
    best = Window.partitionBy("src").orderBy(F.col("w").desc(), F.col("dst"))
    return scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def nearest_by_vector(vectors: DataFrame, k: int = 1, block: int = BLOCK) -> DataFrame:
    """The k nearest nodes of every node by positive cosine, over the whole table of vectors: (src, dst, w)."""
    nodes = vectors.select(PRODUCT, F.lit("all").alias(GROUP), l2_normalised(F.col("embedding")).alias("unit"))
    return top_neighbours(_nearest_by_cosine(settled(nodes, "nodes"), k, block), k)


def symmetrise_max(edges: DataFrame) -> DataFrame:
    """Elementwise maximum of the edge set and its reverse; a node may end above its top-k."""
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = edges.select(F.inline(F.array(F.struct("src", "dst", "w"), back)))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def substitute_edges(
    product: DataFrame,
    embeddings: DataFrame | None = None,
    products: DataFrame | None = None,
    max_neighbors: int = 50,
    block: int = BLOCK,
) -> DataFrame:
    """The substitute graph as an edge list (graph, src, dst, w), both directions.

    Without embeddings every weight is 1 and the first ``max_neighbors`` ids are kept. With them the
    weight is the cosine, negative ones count as 0, a pair with a missing vector gets 1; the cut
    comes before zero weights are dropped, which is the same as dropping them first because zeros
    rank last.
    """
    k = int(max_neighbors)
    nodes = catalog_nodes(product, products)
    if embeddings is None:
        scored = _first_others(nodes, nodes, k)
    else:
        vectors = embeddings.select(PRODUCT, l2_normalised(F.col("embedding")).alias("unit"))
        nodes = settled(nodes.join(vectors, PRODUCT, "left"), "catalog")
        with_vec = nodes.filter(F.col("unit").isNotNull())
        without = nodes.filter(F.col("unit").isNull()).select(PRODUCT, GROUP)
        keys = nodes.select(PRODUCT, GROUP)
        candidates = (
            _nearest_by_cosine(with_vec, k, block)
            .unionByName(_first_others(with_vec.select(PRODUCT, GROUP), without, k))
            .unionByName(_first_others(without, keys, k))
        )
        scored = top_neighbours(candidates, k)
    return symmetrise_max(scored).select(F.lit(SUB).alias("graph"), "src", "dst", "w")
