"""Complement graph: basket co-occurrence counts and normalised positive PMI."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecart.config import COMP, PRODUCT, spread_shuffles
from ripplecart.functions.distributed import block_pairs, broadcast_if_small, has_at_most, hash_rank, settled
from ripplecart.operators.pair_grid import BASKET, BLOCK_ITEMS, grid_pairs, grid_side, product_blocks
from ripplecart.operators.panel import in_universe

WIDE_BASKET = 1000
WORD = 63  # baskets per bigint of membership bits
TILE = 16  # words compared at once
BLOCK = 1024
#: Pairs that a task makes out of its baskets.
MADE_PAIRS = 2_000_000
#: Pairs of baskets that are exchanged at most; beyond, blocks of products are.
EXCHANGED_PAIRS = 5_000_000


def basket_items(tx: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Distinct (basket, product), restricted to the product universe before anything is counted."""
    items = tx.select(BASKET, PRODUCT).na.drop()
    if products is not None:
        items = in_universe(items, products)
    return items.distinct()


def product_baskets(items: DataFrame) -> DataFrame:
    """Number of baskets per product; the items are distinct, so a plain count suffices."""
    return items.groupBy(PRODUCT).agg(F.count(F.lit(1)).alias("n_baskets"))


def basket_total(items: DataFrame) -> DataFrame:
    return items.agg(F.count_distinct(BASKET).alias("n_total"))


def _pair_tasks(sizes: DataFrame, wide_basket: int) -> int:
    """Tasks for the pairs of all baskets up to this width, by their number: a basket of n items makes n * (n - 1) / 2 pairs."""
    n = F.col("n_items").cast("bigint")
    made = sizes.filter(n <= wide_basket).agg(F.coalesce(F.sum((n * (n - 1)).cast("bigint")), F.lit(0))).first()[0] // 2
    return made // MADE_PAIRS + 1


def _pairs_of_narrow_baskets(items: DataFrame, parts: int) -> DataFrame:
    """Pair counts of baskets whose width is bounded, so one basket is one bounded array.

    The number of tasks is given: adaptive execution would go by the bytes of the items and make hundreds of pairs per item
    in a few tasks. The shuffle of the pairs starts with as many parts.
    """
    now = items.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    spread_shuffles(items.sparkSession, max(parts, int(now or 0)))
    baskets = items.repartition(parts, BASKET).groupBy(BASKET).agg(F.array_sort(F.collect_list(PRODUCT)).alias("ps"))
    heads = baskets.filter(F.size("ps") > 1).select("ps", F.posexplode("ps").alias("i", "a"))
    rest = F.slice(F.col("ps"), F.col("i") + 2, F.size("ps"))
    return (
        heads.select("a", F.explode(rest).alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n_narrow"))
    )


def _basket_words(wide: DataFrame, sizes: DataFrame) -> DataFrame:
    """Membership of products in wide baskets as bit words: (product, word, bits)."""
    numbered = hash_rank(sizes.select(BASKET), [BASKET], "_no", seed=0, tag="basket")
    bit = F.expr(f"shiftleft(1L, cast(pmod(_no, {WORD}) as int))")
    at = numbered.select(BASKET, F.floor(F.col("_no") / WORD).alias("word"), bit.alias("bit"))
    return wide.join(at, BASKET).groupBy(PRODUCT, "word").agg(F.bit_or("bit").alias("bits"))


def _common_bits(at_least: int, tile: int):
    """Pairs of products of two blocks with at least this many common bits."""

    def matrix(ids: np.ndarray, words) -> np.ndarray:
        packed = np.ascontiguousarray(np.asarray(words, dtype=np.int64).reshape(len(ids), tile))
        return np.unpackbits(packed.view(np.uint8), axis=1).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a_ids, a_words, b_ids, b_words in zip(pdf.a_ids, pdf.a_vecs, pdf.b_ids, pdf.b_vecs, strict=True):
                a, b = np.asarray(a_ids), np.asarray(b_ids)
                i, j = np.nonzero(matrix(a, a_words) @ matrix(b, b_words).T >= at_least)
                lo, hi = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
                yield pd.DataFrame({"a": lo[lo < hi], "b": hi[lo < hi]})

    return run


def _pairs_of_wide_baskets(
    words: DataFrame, n_wide: int, k: int, block: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """Pairs that may share ``k`` wide baskets, found by multiplying membership matrices.

    The wide baskets are cut into tiles of ``tile`` words. A pair with k common baskets has at least
    k / tiles of them in some tile, so every tile hands out only the pairs that reach this share:
    with a single tile exactly the pairs that qualify. Nothing is emitted per basket.
    """
    tiles = n_wide // (tile * WORD) + 1
    at_least = max(-(-k // tiles), 1)
    place = F.pmod(F.col("word"), F.lit(tile))
    row = F.array(*[F.coalesce(F.bit_or(F.when(place == i, F.col("bits"))), F.lit(0)) for i in range(tile)])
    members = (
        words.groupBy(PRODUCT, F.floor(F.col("word") / tile).alias("tile"))
        .agg(row.alias("bits"), F.sum(F.bit_count("bits")).alias("n"))
        .filter(F.col("n") >= at_least)
    )
    pairs = block_pairs(members, "tile", PRODUCT, "bits", block)
    return pairs.mapInPandas(_common_bits(at_least, tile), "a bigint, b bigint").distinct()


def _grid(items: DataFrame, wide_basket: int) -> tuple[int, int]:
    """Blocks of products whose pairs are counted in a grid, 0 where baskets hand out their pairs; and the number of baskets.

    A task's equal pairs are exchanged as one, so few products make few pairs whatever the baskets. Wide baskets of a single tile hand out
    only pairs that qualify; several tiles hand out nearly all. A grid wants every product's baskets in one block.
    """
    n = F.col("n_items").cast("bigint")
    pairs, wide = n * (n - 1), n > wide_basket
    sizes = items.groupBy(BASKET).agg(F.count(F.lit(1)).alias("n_items")).agg(
        F.count(F.lit(1)).alias("baskets"), F.sum(n).alias("items"), F.sum(pairs).alias("made"),
        F.sum(F.when(wide, 0).otherwise(pairs)).alias("narrow"), F.count_if(wide).alias("wide"),
    ).first()
    made, narrow = (sizes["made"] or 0) // 2, (sizes["narrow"] or 0) // 2
    if made <= EXCHANGED_PAIRS:
        return 0, sizes["baskets"]
    products = items.agg(F.approx_count_distinct(PRODUCT)).first()[0]
    exchanged = (narrow // MADE_PAIRS + 1) * min(narrow, MADE_PAIRS, products * products // 2)
    side = grid_side(sizes["items"], products, made)
    if sizes["wide"] <= TILE * WORD and (exchanged <= EXCHANGED_PAIRS or made > 10 * narrow or (side + 1) * sizes["items"] > 3 * exchanged):
        return 0, sizes["baskets"]
    most = sizes["baskets"] if sizes["baskets"] <= BLOCK_ITEMS else product_baskets(items).agg(F.max("n_baskets")).first()[0]
    return (side if most <= BLOCK_ITEMS else 0), sizes["baskets"]


def cooccurrence(items: DataFrame, min_cooccurrence: int = 10, wide_basket: int = WIDE_BASKET) -> DataFrame:
    """Exact number of common baskets per product pair a < b: (a, b, n_ab) with n_ab >= minimum.

    Products in fewer than the minimum of baskets cannot be in a kept pair and go first. Baskets up
    to ``wide_basket`` products emit their pairs. Wider ones never do: their common baskets are
    counted by AND-ing bit words, for the pairs the narrow baskets already found (when the missing
    count is still within reach) and for pairs that could qualify on wide baskets alone. Where baskets would hand
    out more pairs than can be exchanged, blocks of products meet in a grid instead. The items are
    read several times, so they are saved first.
    """
    items = settled(items, "items")
    side, _ = _grid(items, wide_basket)
    if not side:
        return _cooccurrence(items, min_cooccurrence, wide_basket)
    k = max(int(min_cooccurrence), 1)
    return grid_pairs(product_blocks(items, k, side), side, k).select("a", "b", "n_ab")


def _cooccurrence(items: DataFrame, min_cooccurrence: int, wide_basket: int) -> DataFrame:
    """The counts of `cooccurrence` from saved items."""
    k = max(int(min_cooccurrence), 1)
    frequent, _ = broadcast_if_small(product_baskets(items).filter(F.col("n_baskets") >= k).select(PRODUCT))
    items = items.join(frequent, PRODUCT, "left_semi")
    sizes = items.groupBy(BASKET).agg(F.count(F.lit(1)).alias("n_items"))
    sizes = settled(sizes, "sizes")
    parts = _pair_tasks(sizes, wide_basket)
    wide_sizes = settled(sizes.filter(F.col("n_items") > wide_basket))
    if wide_sizes.isEmpty():
        return _pairs_of_narrow_baskets(items, parts).filter(F.col("n_narrow") >= k).withColumnRenamed("n_narrow", "n_ab")

    ids = wide_sizes.select(BASKET)
    ids = F.broadcast(ids) if has_at_most(wide_sizes) else ids
    wide = items.join(ids, BASKET, "left_semi")
    narrow = items.join(ids, BASKET, "left_anti")
    in_wide, _ = broadcast_if_small(wide.groupBy(PRODUCT).agg(F.count(F.lit(1)).alias("h")))
    reach = F.least("ha", "hb")
    found = settled(
        _pairs_of_narrow_baskets(narrow, parts)
        .join(in_wide.select(F.col(PRODUCT).alias("a"), F.col("h").alias("ha")), "a", "left")
        .join(in_wide.select(F.col(PRODUCT).alias("b"), F.col("h").alias("hb")), "b", "left")
        .na.fill(0, subset=["ha", "hb"])
        .filter(F.col("n_narrow") + reach >= k)
        .select("a", "b", F.col("n_narrow").alias("n"), (reach > 0).alias("both_wide"))
    )
    words = settled(_basket_words(wide, wide_sizes), "words")
    alone = _pairs_of_wide_baskets(words, wide_sizes.count(), k)
    candidates = found.filter("both_wide").select("a", "b").unionByName(alone).distinct()
    in_common = (
        candidates.join(words.select(F.col(PRODUCT).alias("a"), "word", F.col("bits").alias("bits_a")), "a")
        .join(words.select(F.col(PRODUCT).alias("b"), "word", F.col("bits").alias("bits_b")), ["b", "word"])
        .groupBy("a", "b")
        .agg(F.sum(F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))).alias("n"))
        .filter(F.col("n") > 0)
    )
    counts = found.select("a", "b", "n").unionByName(in_common)
    return counts.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= k)


def symmetric(pairs: DataFrame, weight: str = "w") -> DataFrame:
    """Both directions of an undirected pair table (a, b, weight) as (src, dst, w)."""
    w = F.col(weight).alias("w")
    one = F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), w)
    two = F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), w)
    return pairs.select(F.inline(F.array(one, two)))


def _pmi(total: Column) -> Column:
    return F.log(F.col("n_ab") * total / (F.col("n_a") * F.col("n_b")))


def ppmi_pairs(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Positive PMI per pair, divided by the largest one: (a, b, n_ab, w); PMI <= 0 is dropped."""
    marginal, _ = broadcast_if_small(product_baskets(items))
    pmi = _pmi(basket_total(items).scalar())
    scored = (
        pairs.join(marginal.select(F.col(PRODUCT).alias("a"), F.col("n_baskets").alias("n_a")), "a")
        .join(marginal.select(F.col(PRODUCT).alias("b"), F.col("n_baskets").alias("n_b")), "b")
        .select("a", "b", "n_ab", pmi.alias("pmi"))
        .filter(F.col("pmi") > 0)
    )
    return scored.select("a", "b", "n_ab", (F.col("pmi") / scored.agg(F.max("pmi")).scalar()).alias("w"))


def _ppmi_of_grid(blocks: DataFrame, side: int, k: int, n_total: int) -> DataFrame:
    """The same of pairs that are counted where they are read, so neither counts nor weights are written.

    The largest PMI comes first. n_ab / (n_a * n_b) is at most 1 / max(n_a, n_b), so once the rare products have given a
    pair, only products rare enough to reach its share can give a larger one.
    """
    pmi = _pmi(F.lit(n_total))

    def top(most: int | None):
        pairs = grid_pairs(blocks, side, k, most, only_top=True)
        return pairs.agg(F.max(F.struct(pmi.alias("pmi"), "n_ab", "n_a", "n_b"))).first()[0]

    rare = blocks.select(F.explode("n").alias("n")).agg(F.percentile_approx("n", 0.05)).first()[0] or 0
    best = top(rare)
    reach = None if best is None else best["n_a"] * best["n_b"] // best["n_ab"]
    if reach is None or reach > rare:
        best = top(reach)
    scored = grid_pairs(blocks, side, k).select("a", "b", "n_ab", pmi.alias("pmi")).filter(F.col("pmi") > 0)
    return scored.select("a", "b", "n_ab", (F.col("pmi") / F.lit(best and best["pmi"]).cast("double")).alias("w"))


def complement_pairs(
    tx: DataFrame,
    min_cooccurrence: int = 10,
    products: DataFrame | None = None,
    wide_basket: int = WIDE_BASKET,
) -> DataFrame:
    """The complement graph as pairs (a, b, n_ab, w) with a < b, w in (0, 1]."""
    items = settled(basket_items(tx, products), "items")
    side, n_total = _grid(items, wide_basket)
    if not side:
        return ppmi_pairs(items, settled(_cooccurrence(items, min_cooccurrence, wide_basket), "pairs"))
    k = max(int(min_cooccurrence), 1)
    return _ppmi_of_grid(product_blocks(items, k, side), side, k, n_total)


def edges_of_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, w) as an edge list (graph, src, dst, w), both directions."""
    return symmetric(pairs).select(F.lit(COMP).alias("graph"), "src", "dst", "w")


def complement_edges(
    tx: DataFrame,
    min_cooccurrence: int = 10,
    products: DataFrame | None = None,
    wide_basket: int = WIDE_BASKET,
) -> DataFrame:
    """The complement graph as an edge list (graph, src, dst, w), both directions, w in (0, 1]."""
    return edges_of_pairs(complement_pairs(tx, min_cooccurrence, products, wide_basket))


def complement_nodes(tx: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Node index of the graph: all products sold, isolated ones included; or the given universe."""
    return (tx.select(PRODUCT).na.drop() if products is None else products.select(PRODUCT)).distinct()
