"""Random walks on a product graph, as joins of a walk frontier with the transition table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplecart.config import PRODUCT
from ripplecart.functions.distributed import BROADCAST_ROWS, broadcast_if_small, global_rank, has_at_most, settled
from ripplecart.functions.scalars import hash_uniform

STEPS_PER_CHECKPOINT = 5


def transition_table(edges: DataFrame) -> DataFrame:
    """Row-normalised weights with their running total: (src, dst, prob, cum), by dst within src."""
    upto = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    total = edges.groupBy("src").agg(F.sum("w").alias("total"))
    return (
        edges.join(total, "src")
        .withColumn("prob", F.col("w") / F.col("total"))
        .select("src", "dst", "prob", F.sum("prob").over(upto).alias("cum"))
    )


def walk_starts(nodes: DataFrame, num_walks: int) -> DataFrame:
    """(walk_id, start): ``num_walks`` walks per node, walk_id = node rank * num_walks + r."""
    block = F.floor(F.col(PRODUCT) / 65536)
    ranked = global_rank(nodes.select(PRODUCT).distinct(), block, [PRODUCT], "_rank")
    return ranked.select(
        F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("r"), F.col("_rank"), F.col(PRODUCT).alias("start")
    ).select(((F.col("_rank") - 1) * num_walks + F.col("r")).alias("walk_id"), "start")


def _slots(edges: DataFrame) -> DataFrame:
    """Transitions cut into as many equal slots of [0, 1) as the node has neighbours.

    A uniform number falls into one slot, which holds about two transitions whatever the degree, so
    a step is an equi-join on (node, slot): a hub never sends its whole neighbour list to a walker,
    and walkers that crowd on a hub spread over its slots.
    """
    by_dst = Window.partitionBy("src").orderBy("dst")
    degree = _degree(edges)
    spans = (
        transition_table(edges)
        .join(degree, "src")
        .select(
            "src",
            "dst",
            "deg",
            F.coalesce(F.lag("cum").over(by_dst), F.lit(0.0)).alias("lo"),
            # rounding may leave the last running total just below 1
            F.when(F.lead("cum").over(by_dst).isNull(), F.lit(2.0)).otherwise(F.col("cum")).alias("hi"),
        )
    )
    first = F.floor(F.col("lo") * F.col("deg"))
    final = F.least(F.floor(F.col("hi") * F.col("deg")), F.col("deg") - 1)
    slots = spans.select("src", "dst", "lo", "hi", F.explode(F.sequence(first, F.greatest(first, final))).alias("slot"))
    next_degree = degree.select(F.col("src").alias("dst"), F.col("deg").alias("dst_deg"))
    return slots.join(next_degree, "dst", "left").select("src", "slot", "dst", "lo", "hi", "dst_deg")


def _degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))


def _merge_chunks(parts: list[DataFrame]) -> DataFrame:
    """Chunks (walk_id, at, nodes) merged into whole walks of product ids as strings."""
    chunks = reduce(DataFrame.unionByName, parts)
    whole = chunks.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("at", "nodes"))).alias("c"))
    return whole.select("walk_id", F.transform(F.flatten("c.nodes"), lambda x: x.cast("string")).alias("walk"))


def _run_chunks(state: DataFrame, walk_length: int, hop) -> DataFrame:
    """Apply ``hop(state, step)`` walk_length - 1 times; it appends the next node to ``path``.

    A chunk of steps is one job, written to the checkpoint folder: the lineage stays short, a lost
    executor costs one chunk, and only the frontier, not the walked path, goes on to the next one.
    """
    parts = [state.select("walk_id", F.lit(0).alias("at"), F.array("cur").alias("nodes"))]
    state = state.withColumn("path", F.array().cast("array<bigint>"))
    for first in range(1, walk_length, STEPS_PER_CHECKPOINT):
        for step in range(first, min(first + STEPS_PER_CHECKPOINT, walk_length)):
            state = hop(state, step)
        state = settled(state, "walks")
        parts.append(state.select("walk_id", F.lit(first).alias("at"), F.col("path").alias("nodes")))
        state = state.filter(F.col("cur").isNotNull()).withColumn("path", F.array().cast("array<bigint>"))
    return _merge_chunks(parts)


def _appended(path: Column, node: Column) -> Column:
    return F.when(node.isNull(), path).otherwise(F.array_append(path, node))


def unbiased_walks(
    edges: DataFrame, nodes: DataFrame, num_walks: int = 10, walk_length: int = 80, seed: int = 42, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Weighted first-order walks: (walk_id, walk). A node without neighbours ends its walk.

    Step s takes the first neighbour, by id, whose running total exceeds the walk's hash uniform. Slots up to ``max_rows`` are
    broadcast; beyond, as many walkers are, and a step scans the slots instead of sorting them; else both are shuffled.
    """
    slots, small = broadcast_if_small(_slots(edges), max_rows)
    degree = _degree(edges).withColumnRenamed("src", "cur")
    starts = walk_starts(nodes, num_walks).withColumnRenamed("start", "cur").join(degree, "cur", "left")
    if not small:
        starts = settled(starts, "starts")
    few_walkers = not small and has_at_most(starts)

    def hop(state: DataFrame, step: int) -> DataFrame:
        drawn = state.withColumn("u", hash_uniform(seed, "walk", F.col("walk_id"), step))
        found = (
            (F.col("cur") == F.col("src"))
            & (F.floor(F.col("u") * F.col("deg")) == F.col("slot"))
            & (F.col("u") >= F.col("lo"))
            & (F.col("u") < F.col("hi"))
        )
        if few_walkers:
            drawn = settled(drawn, "walkers")
            met = slots.join(F.broadcast(drawn.drop("path")), found).select("walk_id", "dst", "dst_deg")
            moved = drawn.join(met, "walk_id", "left")
        else:
            moved = drawn.join(slots, found, "left")
        return moved.select(
            "walk_id",
            F.col("dst").alias("cur"),
            F.col("dst_deg").alias("deg"),
            _appended(F.col("path"), F.col("dst")).alias("path"),
        )

    return _run_chunks(starts, walk_length, hop)


def biased_walks(
    edges: DataFrame,
    nodes: DataFrame,
    num_walks: int = 10,
    walk_length: int = 80,
    p: float = 1.0,
    q: float = 1.0,
    seed: int = 42,
    trials: int = 4,
) -> DataFrame:
    """Second-order walks with return parameter p and in-out parameter q: (walk_id, walk).

    From the second step on a neighbour weighs w / p when it is the previous node, w when it is a
    neighbour of the previous node, else w / q. Steps are drawn by rejection: a neighbour is proposed by its weight
    alone, through the slots of the unbiased walk, and taken with its factor over the largest factor, after one probe
    whether it neighbours the previous node. A round makes ``trials`` proposals for every walker and the first that is
    taken moves it; a walker without luck stays where it is and goes on proposing in the next round, so walkers need not
    be in step. A round has walkers x trials rows whatever the degrees, and never meets a node's neighbour list.
    """
    slots, _ = broadcast_if_small(_slots(edges))
    known, _ = broadcast_if_small(edges.select(F.col("src").alias("_prev"), F.col("dst").alias("_near")))
    top = max(1.0, 1.0 / p, 1.0 / q)
    state = (
        walk_starts(nodes, num_walks)
        .withColumnRenamed("start", "cur")
        .join(_degree(edges).withColumnRenamed("src", "cur"), "cur", "left")
        .select("walk_id", "cur", "deg", F.lit(None).cast("bigint").alias("prev"), F.lit(0).alias("step"), F.lit(0).alias("trial"))
    )
    parts = [state.select("walk_id", F.lit(0).alias("at"), F.array("cur").alias("nodes"))]
    walking = (F.col("step") < walk_length - 1) & F.col("deg").isNotNull()

    def hop(state: DataFrame) -> DataFrame:
        tries = F.when(walking, F.sequence(F.col("trial"), F.col("trial") + trials - 1)).otherwise(F.array("trial"))
        drawn = state.withColumn("k", F.explode(tries)).withColumn("u", hash_uniform(seed, "bwalk", F.col("walk_id"), F.col("step") + 1, F.col("k")))
        found = (
            walking
            & (F.col("cur") == F.col("src"))
            & (F.floor(F.col("u") * F.col("deg")) == F.col("slot"))
            & (F.col("u") >= F.col("lo"))
            & (F.col("u") < F.col("hi"))
        )
        probed = drawn.join(slots, found, "left").join(known, (F.col("prev") == F.col("_prev")) & (F.col("dst") == F.col("_near")), "left")
        factor = (
            F.when(F.col("prev").isNull(), top)
            .when(F.col("dst") == F.col("prev"), 1.0 / p)
            .when(F.col("_near").isNotNull(), 1.0)
            .otherwise(1.0 / q)
        )
        taken = F.col("dst").isNotNull() & (hash_uniform(seed, "baccept", F.col("walk_id"), F.col("step") + 1, F.col("k")) * top < factor)
        same = ("step", "trial", "prev", "cur", "deg", "path")
        best = probed.groupBy("walk_id").agg(*[F.first(c).alias(c) for c in same], F.min(F.when(taken, F.struct("k", "dst", "dst_deg"))).alias("best"))
        moved, node = F.col("best").isNotNull(), F.col("best.dst")
        return best.select(
            "walk_id",
            F.when(moved, node).otherwise(F.col("cur")).alias("cur"),
            F.when(moved, F.col("best.dst_deg")).otherwise(F.col("deg")).alias("deg"),
            F.when(moved, F.col("cur")).otherwise(F.col("prev")).alias("prev"),
            F.when(moved, F.col("step") + 1).otherwise(F.col("step")).alias("step"),
            F.when(moved, 0).otherwise(F.col("trial") + trials).alias("trial"),
            _appended(F.col("path"), node).alias("path"),
        )

    state = settled(state.filter(walking), "walks")
    while not state.isEmpty():
        state = state.withColumn("path", F.array().cast("array<bigint>"))
        for _ in range(STEPS_PER_CHECKPOINT):
            state = hop(state)
        state = settled(state, "walks")
        parts.append(state.select("walk_id", (F.col("step") - F.size("path") + 1).alias("at"), F.col("path").alias("nodes")))
        state = state.drop("path").filter(walking)
    return _merge_chunks(parts)
