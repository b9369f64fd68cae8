"""Common baskets of all product pairs by a grid of product blocks: no pair of a basket is exchanged or written."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.config import PRODUCT
from ripplecart.functions.distributed import broadcast_if_small

BASKET = "BASKET_ID"
#: Pairs of baskets' products that a pair of blocks meets, one by one; and as many as are sorted at once.
MET_PAIRS, SORTED_PAIRS = 150_000_000, 1 << 21
#: Products and (basket, product) rows of a block.
BLOCK_PRODUCTS, BLOCK_ITEMS = 40_000, 2_000_000
MOST_TASKS = 50_000
PAIRS = "a bigint, b bigint, n_ab bigint, n_a bigint, n_b bigint"


class Block(NamedTuple):
    """Products of a block with their numbers of baskets, and the places of its products in each of its baskets."""

    ids: np.ndarray
    n: np.ndarray
    baskets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    places: np.ndarray


def grid_side(n_items: int, n_products: int, n_pairs: int) -> int:
    """Blocks of products, so that no block and no pair of blocks grows with the tables."""
    return max(-(-n_products // BLOCK_PRODUCTS), -(-n_items // BLOCK_ITEMS), round((2 * n_pairs / MET_PAIRS) ** 0.5), 1)


def _kind(ids) -> type:
    return np.uint16 if len(ids) <= 1 << 16 else np.uint32


def _packed(at_least: int):
    """The rows of a block as one row: products in at least so many baskets, with places of them by basket."""

    def run(table: pa.Table) -> pa.Table:
        basket, product = np.asarray(table.column(BASKET)), np.asarray(table.column(PRODUCT))
        ids, place, n = np.unique(product, return_inverse=True, return_counts=True)
        often = n >= at_least
        used = often[place]
        basket, place = basket[used], (np.cumsum(often) - 1)[place[used]]
        order = np.lexsort((place, basket))
        baskets, sizes = np.unique(basket[order], return_counts=True)
        ids = ids[often]
        return pa.table(
            {
                "blk": pa.array([table.column("_blk")[0].as_py()], pa.int64()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "n": pa.array([n[often]], pa.list_(pa.int64())),
                "baskets": pa.array([baskets], pa.list_(pa.int64())),
                "ends": pa.array([np.cumsum(sizes)], pa.list_(pa.int64())),
                "places": pa.array([place[order].astype(_kind(ids)).tobytes()], pa.binary()),
            }
        )

    return run


def product_blocks(items: DataFrame, at_least: int, side: int) -> DataFrame:
    """Distinct (basket, product) rows as ``side`` rows of arrays, saved; a product's rows lie in one block. Small ones are hinted."""
    cells = items.select(F.col(BASKET).cast("bigint").alias(BASKET), F.col(PRODUCT).cast("bigint").alias(PRODUCT))
    dealt = cells.withColumn("_blk", F.pmod(F.xxhash64(PRODUCT), F.lit(side)))
    schema = "blk bigint, ids array<bigint>, n array<bigint>, baskets array<bigint>, ends array<bigint>, places binary"
    return broadcast_if_small(dealt.groupBy("_blk").applyInArrow(_packed(at_least), schema))[0]


def _block(batch: pa.RecordBatch, row: int, side: str, most: int | None) -> Block:
    """One block of a row of the grid; with ``most``, its products in up to as many baskets."""
    ids, n, baskets, ends = (np.asarray(batch.column(f"{side}_{c}")[row].values) for c in ("ids", "n", "baskets", "ends"))
    places = np.frombuffer(batch.column(f"{side}_places")[row].as_buffer(), _kind(ids))
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    if most is not None:
        kept = n[places] <= most
        before = np.r_[0, np.cumsum(kept)]
        starts, ends, places = before[starts], before[ends], places[kept]
    return Block(ids, n, baskets, starts, ends, places)


def _ranges(first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each width, end to end."""
    at = np.repeat(first - np.cumsum(width) + width, width)
    at += np.arange(len(at))
    return at


def common_baskets(a: Block, b: Block, same: bool, at_least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a, in b and the number of common baskets of the pairs with at least so many; in one block each pair once.

    Every product of a meets what its baskets hold of b; what comes several times is found by sorting. A product
    that meets more than is sorted at once is counted piece by piece.
    """
    _, in_a, in_b = np.intersect1d(a.baskets, b.baskets, assume_unique=True, return_indices=True)
    other = np.full(len(a.baskets), -1)
    other[in_a] = in_b
    basket = np.repeat(other, a.ends - a.starts)
    met = np.flatnonzero(basket >= 0)
    met = met[np.argsort(a.places[met], kind="stable")]
    one, basket = a.places[met].astype(np.int64), basket[met]
    first = met + 1 if same else b.starts[basket]  # places of a basket ascend
    width = b.ends[basket] - first
    if not len(one):
        return
    total, products = np.cumsum(width), len(b.ids)
    last = np.flatnonzero(np.r_[one[1:] != one[:-1], True])
    made = np.diff(total[last], prepend=0)
    chunk = np.where(made > SORTED_PAIRS, -1 - np.arange(len(last)), total[last] // SORTED_PAIRS)  # a large product alone
    ends = last[np.r_[chunk[1:] != chunk[:-1], True]] + 1
    for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True):
        if one[lo] == one[hi - 1] and total[hi - 1] - total[lo] + width[lo] > SORTED_PAIRS:
            n = np.zeros(products, np.int64)
            pieces = np.r_[np.unique((total[lo:hi] - total[lo]) // SORTED_PAIRS, return_index=True)[1], hi - lo] + lo
            for s, e in zip(pieces[:-1], pieces[1:], strict=True):
                n += np.bincount(b.places[_ranges(first[s:e], width[s:e])], minlength=products)
            found = np.flatnonzero(n >= at_least)
            yield np.full(len(found), one[lo]), found, n[found]
            continue
        kind = np.uint32 if (int(one[hi - 1] - one[lo]) + 1) * products < 1 << 32 else np.uint64
        key = np.repeat(((one[lo:hi] - one[lo]) * products).astype(kind), width[lo:hi])
        key += b.places[_ranges(first[lo:hi], width[lo:hi])]
        key.sort()
        key = key[at_least - 1 :][key[at_least - 1 :] == key[: max(len(key) - at_least + 1, 0)]]
        if len(key):
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            pair = key[begin].astype(np.int64)
            yield pair // products + one[lo], pair % products, np.diff(begin, append=len(key)) + at_least - 1


def _counted(at_least: int, most: int | None, only_top: bool):
    """Pairs with their numbers of baskets; or of all pairs of a task the one with the largest n_ab / (n_a * n_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = _block(batch, row, "a", most), _block(batch, row, "b", most)
                for i, j, n_ab in common_baskets(a, b, batch.column("same")[row].as_py(), at_least):
                    if only_top and len(i):
                        share = n_ab / (a.n[i] * b.n[j])
                        at = int(share.argmax())
                        if top is None or share[at] > top[0]:
                            top = share[at], (a.ids[i[at]], b.ids[j[at]], n_ab[at], a.n[i[at]], b.n[j[at]])
                    elif len(i):
                        x, y, n_x, n_y = a.ids[i], b.ids[j], a.n[i], b.n[j]
                        turned = x > y
                        columns = np.minimum(x, y), np.maximum(x, y), n_ab, np.where(turned, n_y, n_x), np.where(turned, n_x, n_y)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_ab", "n_a", "n_b"])
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in top[1]], names=["a", "b", "n_ab", "n_a", "n_b"])

    return run


def grid_pairs(blocks: DataFrame, side: int, at_least: int, most: int | None = None, only_top: bool = False) -> DataFrame:
    """Pairs a < b with at least so many common baskets: (a, b, n_ab, n_a, n_b), made where they are read.

    A pair of blocks is a task. Small blocks are broadcast, others are shuffled, a copy per pair; pairs of products are neither.
    """
    spark, number = blocks.sparkSession, side * (side + 1) // 2
    i = F.col("id") % side
    grid = spark.range(0, number, 1, min(number, MOST_TASKS)).select(i.alias("a_blk"), ((i + F.floor(F.col("id") / side)) % side).alias("b_blk"))
    of = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns])
    met = grid.join(of("a"), "a_blk").join(of("b"), "b_blk").withColumn("same", F.col("a_blk") == F.col("b_blk"))
    return met.mapInArrow(_counted(at_least, most, only_top), PAIRS)
