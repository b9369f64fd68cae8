"""Exposure of a panel row to its treated graph neighbours in the same store and week."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplecart.config import CELL, COMP, PRODUCT, SPILLOVER_FEATURES, STORE, SUB, WEEK
from ripplecart.functions.distributed import BROADCAST_ROWS
from ripplecart.functions.scalars import edge_weight, safe_ratio

STORE_WEEK = [STORE, WEEK]
SOURCE = [STORE, WEEK, "src"]
CHANNELS = {SUB: "sub_exposure", COMP: "comp_exposure"}
BY_GRAPH = {f"w_{g}": g for g in CHANNELS}
#: Edges, and rows of the panel, that a task multiplies: some 30 bytes each, a few times over.
MATRIX_EDGES, MATRIX_ROWS = 4_000_000, 4_000_000


def without_channel(edges: DataFrame, graph: str) -> DataFrame:
    """Switch one graph off: its columns stay and become 0."""
    return edges.filter(F.col("graph") != graph)


@dataclass(frozen=True)
class EdgeLayout:
    """How the edges meet the rows: a broadcast list, or a grid of blocks in a shuffle.

    ``by_dst`` blocks of about ``block_rows`` edges each, by the giving product; ``by_src`` parts of a block, more than
    one only where a product has more edges than a block; ``groups`` of store-weeks, each of which meets every block.
    ``by_dst`` = 0 stands for a list small enough to be broadcast.
    """

    edges: DataFrame
    by_dst: int = 0
    by_src: int = 1
    groups: int = 1
    n_edges: int = 0

    def select(self, *cols: Column | str) -> EdgeLayout:
        return replace(self, edges=self.edges.select(*cols))

    @property
    def broadcast(self) -> bool:
        return self.by_dst == 0


def edge_layout(edges: DataFrame, block_rows: int = BROADCAST_ROWS) -> EdgeLayout:
    """The layout of an edge list, from one count per giving product.

    An edge row is four numbers, so a list within the default bound is some 32 MB and is broadcast.
    """
    per_product = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    size = per_product.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if size["n"] <= block_rows:
        return EdgeLayout(edges)
    by_dst, by_src = -(-size["n"] // block_rows), -(-size["most"] // block_rows)
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return EdgeLayout(edges, by_dst, by_src, max(1, -(-4 * tasks // (by_dst * by_src))), size["n"])


def _weights_by_graph(layout: EdgeLayout, w: Column) -> EdgeLayout:
    """One weight column per graph, 0 outside it: the hot loop multiplies instead of comparing labels."""
    per_graph = [F.when(F.col("graph") == g, w).otherwise(F.lit(0.0)).alias(f"w_{g}") for g in CHANNELS]
    return layout.select("src", "dst", *per_graph)


def _block(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _pushed(rows: DataFrame, layout: EdgeLayout, cell: list[str]) -> DataFrame:
    """Present rows next to each edge that leads to them.

    In a grid, a row goes to the block of its product within the group of its ``cell`` (once per part of the block),
    and a copy of each block of edges goes to every group. The two meet by (group, block, part), so what one store-week
    sends to one receiver out of a block is summed in the task that makes it.
    """
    if layout.broadcast:
        return rows.join(F.broadcast(layout.edges), F.col(PRODUCT) == F.col("dst"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("_dst", _block(F.col(PRODUCT), layout.by_dst))
    edges = layout.edges.withColumn("_dst", _block(F.col("dst"), layout.by_dst)).withColumnRenamed("dst", PRODUCT)
    at = ["_dst"]
    if layout.groups > 1:
        dealt, edges = dealt.withColumn("_group", _block(F.struct(*cell), layout.groups)), edges.withColumn("_group", every(layout.groups))
        at.append("_group")
    if layout.by_src > 1:
        dealt, edges = dealt.withColumn("_src", every(layout.by_src)), edges.withColumn("_src", _block(F.col("src"), layout.by_src))
        at.append("_src")
    return dealt.repartition(tasks, *at).join(edges.repartition(tasks, *at).hint("merge"), [*at, PRODUCT]).withColumn("dst", F.col(PRODUCT))


def _neighbour_sums(rows: DataFrame, layout: EdgeLayout, sums: dict[str, Column]) -> DataFrame:
    """Push every present row along its edges and sum at the receiving product.

    A broadcast list: the rows are exchanged once by (store, week), and join and aggregation run inside that stage, so
    the rows-times-degree intermediate is never written or exchanged. A grid of blocks: one join of fixed shape whatever
    the number of edges; each task sums its block's contributions before they are exchanged by receiver, so a
    receiving row gets at most one partial sum per block.
    """
    rows = rows.repartition(*STORE_WEEK) if layout.broadcast else rows
    return _pushed(rows, layout, STORE_WEEK).groupBy(*SOURCE).agg(*[c.alias(name) for name, c in sums.items()])


def _packed(rows: DataFrame, at: str, columns: list[str], along: list[str]) -> DataFrame:
    """Rows of one value of ``at`` that a batch holds, as one row of arrays: copies and sorts of them move few rows.

    Arrays follow ``along``, so its columns come in runs, which a shuffle's compression takes away.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = np.asarray(batch.column(at))
                order = np.lexsort((*[np.asarray(batch.column(c)) for c in reversed(along)], key))
                key, batch = key[order], batch.take(pa.array(order))
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                cuts = pa.array(np.r_[starts, len(key)], pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, batch.column(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(key[starts]), *lists], names=[at, *columns])

    kinds = dict(rows.dtypes)
    return rows.select(at, *columns).mapInArrow(pack, ", ".join([f"{at} int", *[f"{c} array<{kinds[c]}>" for c in columns]]))


def _multiplied(weights: list[str], values: list[str]):
    """Sums at the receivers of a block of edges, for each store-week of a group: a sparse product per weight and value."""

    def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
        flat = lambda table, c: np.asarray(pc.list_flatten(table.column(c)))
        out = [[] for _ in range(3 + len(weights) * len(values))]
        if rows.num_rows and edges.num_rows:  # a group may lack a block, and a block a group
            src_ids, s = np.unique(flat(edges, "src"), return_inverse=True)
            dst_ids, d = np.unique(flat(edges, "dst"), return_inverse=True)
            along, parts = np.argsort(s, kind="stable"), []
            for w in weights:
                weight = flat(edges, w)[along]
                used = weight != 0
                parts.append((s[along][used], d[along][used], weight[used]))
            product = flat(rows, PRODUCT)
            place = np.minimum(np.searchsorted(dst_ids, product), len(dst_ids) - 1)
            known = np.flatnonzero(dst_ids[place] == product)
            store, week = flat(rows, STORE)[known], flat(rows, WEEK)[known]
            by_cell = np.lexsort((week, store))
            store, week, known = store[by_cell], week[by_cell], known[by_cell]
            place, given = place[known], [flat(rows, v)[known] for v in values]
            cuts = np.flatnonzero(np.r_[True, (store[1:] != store[:-1]) | (week[1:] != week[:-1])] if len(known) else [])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(known)], strict=False):
                at = [np.bincount(place[lo:hi], v[lo:hi], len(dst_ids)) for v in given]
                sums = [np.bincount(to, weight * x[by], len(src_ids)) for to, by, weight in parts for x in at]
                got = np.flatnonzero(np.any([y != 0 for y in sums], axis=0))
                cell = [np.full(len(got), store[lo]), np.full(len(got), week[lo], np.int32), src_ids[got]]
                for column, piece in zip(out, [*cell, *[y[got] for y in sums]], strict=True):
                    column.append(piece)
        kinds = [np.int64, np.int32, np.int64, *[np.float64] * (len(out) - 3)]
        names = [STORE, WEEK, "src", *[f"_{i}" for i in range(len(out) - 3)]]
        return pa.table({n: np.concatenate([np.zeros(0, k), *c]).astype(k) for n, c, k in zip(names, out, kinds, strict=True)})

    return run


def _product_sums(
    rows: DataFrame, layout: EdgeLayout, weights: dict[str, str], values: dict[str, Column], block_edges: int = MATRIX_EDGES, group_rows: int = MATRIX_ROWS
) -> DataFrame:
    """Sums at the receiving products, by products of matrices: (STORE, WEEK, src, {prefix}_{value}) per weight and value.

    Edges are cut by receiver into blocks, store-weeks into groups. A task gets one of each, with every present row of
    the group, so its sums are final: rows x degree is neither joined nor exchanged, and no partial sum is. Rows are copied once
    per block and edges once per group, both as arrays. Receivers with all sums 0 are left out.
    """
    blocks = -(-layout.n_edges // block_edges)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-rows.count() // group_rows), -(-tasks // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    given = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in values.items()]
    cell = [F.col(STORE).cast("bigint"), F.col(PRODUCT).cast("bigint"), F.col(WEEK).cast("int")]
    dealt = rows.na.drop(subset=CELL).select(_block(F.struct(*STORE_WEEK), groups).alias("_group"), *cell, *given)
    weight = [F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(w) for w in weights]
    ends = [F.col(c).cast("bigint").alias(c) for c in ("src", "dst")]
    edges = layout.edges.na.drop(subset=["src", "dst"]).select(_block(F.col("src"), blocks).alias("_part"), *ends, *weight)
    at = ["_group", "_part"]
    left = _packed(dealt, "_group", [*CELL, *values], STORE_WEEK).withColumn("_part", every(blocks)).repartition(blocks * groups, *at)
    right = _packed(edges, "_part", ["src", "dst", *weights], ["src"]).withColumn("_group", every(groups)).repartition(blocks * groups, *at)
    names = [f"{prefix}_{value}" for prefix in weights.values() for value in values]
    schema = ", ".join([f"{STORE} bigint, {WEEK} int, src bigint", *[f"_{i} double" for i in range(len(names))]])
    sums = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_multiplied(list(weights), list(values)), schema)
    return sums.toDF(*SOURCE, *names)


def _attach(panel: DataFrame, sums: DataFrame, layout: EdgeLayout) -> DataFrame:
    """Join the sums back; with a broadcast list both sides lie by (store, week)."""
    panel = panel.repartition(*STORE_WEEK) if layout.broadcast else panel
    return panel.join(sums.withColumnRenamed("src", PRODUCT), CELL, "left")


def presence_runs(presence: DataFrame) -> DataFrame:
    """Run-length form of the panel's keys: (store, product, start, end, copies).

    A dense panel has one run per store and product; gaps split a run and duplicate rows change
    its number of copies, so the form is exact for any panel.
    """
    weeks = presence.groupBy(*CELL).agg(F.count(F.lit(1)).alias("copies"))
    along = Window.partitionBy(STORE, PRODUCT, "copies").orderBy(WEEK)
    island = F.col(WEEK) - F.row_number().over(along)
    return (
        weeks.withColumn("_i", island)
        .groupBy(STORE, PRODUCT, "copies", "_i")
        .agg(F.min(WEEK).alias("start"), F.max(WEEK).alias("end"))
        .drop("_i")
    )


def _interval_denominators(panel: DataFrame, presence: DataFrame, layout: EdgeLayout) -> DataFrame:
    """Sum of the weights of present neighbours per panel key, from runs instead of rows.

    A neighbour's run adds its weight at the start and takes it away after the end; a running sum
    over the weeks of one (store, product) gives the total. Neighbours are also counted as integers,
    so 'none present' is exact and not a matter of rounding.
    """
    pushed = _pushed(presence_runs(presence), layout, [STORE])
    turns = F.array(
        F.struct(F.col("start").alias(WEEK), F.col("copies").alias("by")),
        F.struct((F.col("end") + 1).alias(WEEK), (-F.col("copies")).alias("by")),
    )
    steps = pushed.select(STORE, F.col("src").alias(PRODUCT), *[f"w_{g}" for g in CHANNELS], F.inline(turns))
    events = steps.groupBy(*CELL).agg(
        *[F.sum(F.when(F.col(f"w_{g}") != 0, F.col("by")).otherwise(0)).alias(f"{g}_n") for g in CHANNELS],
        *[F.sum(F.col(f"w_{g}") * F.col("by")).alias(f"{g}_den") for g in CHANNELS],
    )
    keys = panel.select(*CELL).distinct()
    names = [f"{g}_{x}" for x in ("n", "den") for g in CHANNELS]
    timeline = (
        keys.withColumn("_row", F.lit(True))
        .unionByName(events, allowMissingColumns=True)
        .groupBy(*CELL)
        .agg(F.bool_or("_row").alias("_row"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    )
    upto = Window.partitionBy(STORE, PRODUCT).orderBy(WEEK).rowsBetween(Window.unboundedPreceding, 0)
    totals = timeline.select(*CELL, "_row", *[F.sum(c).over(upto).alias(c) for c in names])
    return totals.filter("_row").select(
        *CELL,
        *[F.when(F.col(f"{g}_n") > 0, F.col(f"{g}_den")).otherwise(F.lit(0.0)).alias(f"{g}_den") for g in CHANNELS],
    )


def add_exposures(
    panel: DataFrame,
    edges: DataFrame,
    treatment: str = "promo_any",
    weight_type: str = "edge_weight",
    presence: DataFrame | None = None,
    denominator: str = "direct",
    block_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Both channels in one pass: {sub,comp}_exposure_{weighted,sum} next to the panel columns.

    ``weighted`` is sum(w * T) / sum(w) over neighbours with a row in the same store-week, ``sum``
    the numerator. Rows outside a graph, or without a present neighbour, get 0. Duplicate rows add
    up. ``edges`` should be a saved table: it is counted, and broadcast up to ``block_rows`` edges;
    a longer list meets the rows in a shuffled grid, block by block as a product of matrices. ``presence`` says which rows count as present (default: the panel itself, so
    neighbours that were filtered or sampled away are absent).

    ``denominator='interval'`` computes the weight totals from presence runs: then only treated rows
    meet the edges, and the untreated majority of a dense panel is never multiplied by the degree.
    """
    w = edge_weight(weight_type, F.col("w"))
    present = panel if presence is None else presence
    t = F.col(treatment).cast("double")
    rows = present.select(*CELL, t.alias("_t"))
    by_graph = _weights_by_graph(edge_layout(edges, block_rows), w)
    num = {f"{g}_num": F.sum(F.col(f"w_{g}") * F.col("_t")) for g in CHANNELS}
    if denominator == "direct" and not by_graph.broadcast:
        out = _attach(panel, _product_sums(rows, by_graph, BY_GRAPH, {"num": F.col("_t"), "den": F.lit(1.0)}), by_graph)
    elif denominator == "direct":
        den = {f"{g}_den": F.sum(f"w_{g}") for g in CHANNELS}
        out = _attach(panel, _neighbour_sums(rows, by_graph, {**num, **den}), by_graph)
    elif denominator == "interval":
        treated = rows.filter(F.col("_t") != 0)
        out = _attach(panel, _neighbour_sums(treated, by_graph, num), by_graph).join(
            _interval_denominators(panel, present, by_graph), CELL, "left"
        )
    else:
        raise ValueError(f"denominator must be 'direct' or 'interval', got {denominator!r}")
    zero = F.lit(0.0)
    cols = []
    for g, prefix in CHANNELS.items():
        total, den_c = F.coalesce(F.col(f"{g}_num"), zero), F.coalesce(F.col(f"{g}_den"), zero)
        cols += [safe_ratio(total, den_c).alias(f"{prefix}_weighted"), total.alias(f"{prefix}_sum")]
    new = {f"{prefix}_{kind}" for prefix in CHANNELS.values() for kind in ("weighted", "sum")}
    return out.select(*[c for c in panel.columns if c not in new], *cols)


def weighted_exposure(
    panel: DataFrame,
    edges: DataFrame,
    treatment: str = "promo_any",
    weight_type: str = "edge_weight",
    prefix: str = "exposure",
    block_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One graph's exposure: {prefix}_weighted and {prefix}_sum."""
    w = edge_weight(weight_type, F.col("w"))
    rows = panel.select(*CELL, F.col(treatment).cast("double").alias("_t"))
    layout = edge_layout(edges, block_rows).select("src", "dst", w.alias("w"))
    if layout.broadcast:
        sums = _neighbour_sums(rows, layout, {"_num": F.sum(F.col("w") * F.col("_t")), "_den": F.sum("w")})
    else:
        sums = _product_sums(rows, layout, {"w": ""}, {"num": F.col("_t"), "den": F.lit(1.0)})
    total = F.coalesce(F.col("_num"), F.lit(0.0))
    return _attach(panel, sums, layout).select(
        *[c for c in panel.columns if c not in (f"{prefix}_weighted", f"{prefix}_sum")],
        safe_ratio(total, F.coalesce(F.col("_den"), F.lit(0.0))).alias(f"{prefix}_weighted"),
        total.alias(f"{prefix}_sum"),
    )


def add_spillover_features(panel: DataFrame, edges: DataFrame, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Treated neighbours (count, share) and mean units of present neighbours, per graph."""
    rows = panel.select(*CELL, F.col("promo_any").alias("_t"), F.col("units_sold").alias("_u"))
    names = {SUB: "substitutes", COMP: "complements"}
    sums = {}
    for g in names:
        w = F.col(f"w_{g}")
        sums[f"{g}_t"], sums[f"{g}_u"], sums[f"{g}_n"] = F.sum(w * F.col("_t")), F.sum(w * F.col("_u")), F.sum(w)
    one = edge_weight("binary", F.col("w"))
    by_graph = _weights_by_graph(edge_layout(edges, block_rows), one)
    if by_graph.broadcast:
        pushed = _neighbour_sums(rows, by_graph, sums)
    else:
        pushed = _product_sums(rows, by_graph, BY_GRAPH, {"t": F.col("_t"), "u": F.col("_u"), "n": F.lit(1.0)})
    out = _attach(panel, pushed, by_graph)
    cols = []
    for g, name in names.items():
        treated, units, present = (F.coalesce(F.col(f"{g}_{x}"), F.lit(0.0)) for x in "tun")
        cols += [
            treated.cast("bigint").alias(f"n_treated_{name}"),
            safe_ratio(treated, present).alias(f"frac_treated_{name}"),
            safe_ratio(units, present).alias(f"avg_units_{name}"),
        ]
    return out.select(*[c for c in panel.columns if c not in SPILLOVER_FEATURES], *cols)
