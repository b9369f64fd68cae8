"""Label codes and covariate vectors, and the folds for cross-fitting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.config import HIERARCHY, PRODUCT, SPILLOVER_FEATURES, STORE, WEEK
from ripplecart.functions.distributed import broadcast_if_small, distinct_pairs, global_rank, ordered_positions, settled
from ripplecart.functions.scalars import hash_uniform


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """0-based position of each value in the sorted distinct values of its column: (column, value, code).

    All columns share one aggregation; the dictionary is sorted by ranges, a column's labels in many tasks.
    """
    values = distinct_pairs(df, columns).where(F.col("value").isNotNull()).select("column", "value")
    return ordered_positions(values, "column", ["value"], "_code").select("column", "value", F.col("_code").cast("int").alias("code"))


def _attach_codes(df: DataFrame, codes: DataFrame, small: bool, columns: list[str]) -> DataFrame:
    for c in columns:
        one = codes.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        df = df.join(F.broadcast(one) if small else one, c, "left").na.fill(-1, subset=[f"{c}_code"])
    return df


def with_label_codes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``<column>_code`` per categorical column; a missing value gets -1."""
    columns = columns or [c for c in HIERARCHY if c in df.columns]
    codes, small = broadcast_if_small(label_codes(df, columns))
    return _attach_codes(df, codes, small, columns)


@dataclass(frozen=True)
class Covariates:
    """How to add the covariate vector ``w`` (array of doubles) to rows.

    Only the code and embedding tables are saved. The vector itself is put together by broadcast
    joins wherever a pass needs it: written out it would repeat a product's embedding on every row.
    """

    names: list[str]
    categories: list[str]
    codes: DataFrame
    small: bool
    vectors: DataFrame | None
    dim: int

    def attach(self, df: DataFrame) -> DataFrame:
        out = _attach_codes(df, self.codes, self.small, self.categories)
        scalars = [n for n in self.names if not n.startswith("emb_")]
        w = F.array(*[F.col(c).cast("double") for c in scalars])
        if self.vectors is not None:
            out = out.join(self.vectors, PRODUCT, "left")
            zeros = F.array_repeat(F.lit(0.0), self.dim)
            w = F.concat(w, F.coalesce(F.col("_vector"), zeros))
        return out.withColumn("w", w).select(*df.columns, "w")


def covariates(
    df: DataFrame,
    *,
    include_discount_rate: bool = False,
    include_spillover: bool = False,
    embeddings: DataFrame | None = None,
    embedding_dim: int = 64,
) -> Covariates:
    """Store, week and label codes; optionally the discount rate, the six spillover features and the
    product's embedding (zeros when it has none)."""
    cats = [c for c in HIERARCHY if c in df.columns]
    names = [STORE, WEEK, *[f"{c}_code" for c in cats]]
    if include_discount_rate and "discount_rate" in df.columns:
        names.append("discount_rate")
    if include_spillover:
        names += [c for c in SPILLOVER_FEATURES if c in df.columns]
    vectors = None
    if embeddings is not None:
        wide = embeddings.select(PRODUCT, F.col("embedding").cast("array<double>").alias("_vector"))
        vectors, _ = broadcast_if_small(wide, max_rows=200_000)
        names = names + [f"emb_{i}" for i in range(embedding_dim)]
    codes, small = broadcast_if_small(label_codes(df, cats))
    return Covariates(names, cats, codes, small, vectors, embedding_dim)


def fold_runs(runs: list[tuple[int, int]], n_folds: int) -> list[tuple[int, list[int], list[int]]]:
    """Folds of equal-sized groups, dealt one by one to the lightest fold: (size, first folds, then this cycle for ever).

    ``runs`` are (size, groups) by descending size. Within a run the folds level out until none is ahead by a whole
    group; from there on the order repeats, so a run of any length costs no more than the levelling.
    """
    load, out = [0] * n_folds, []
    for size, groups in runs:
        first = []
        while len(first) < groups and max(load) - min(load) >= size:
            lightest = load.index(min(load))
            first.append(lightest)
            load[lightest] += size
        cycle = sorted(range(n_folds), key=lambda k: (load[k], k))
        laps, rest = divmod(groups - len(first), n_folds)
        for i, k in enumerate(cycle):
            load[k] += size * (laps + (i < rest))
        out.append((size, first, cycle))
    return out


def group_folds(df: DataFrame, n_folds: int, group: str = PRODUCT) -> DataFrame:
    """(group, n_rows, fold): whole groups per fold; the largest group first, ties by id, each to the lightest fold so far.

    The driver sees the distinct sizes with their number of groups, never the groups: groups of one size are dealt out by
    their rank among them, which comes from (size, id range) buckets, so even a catalog in which every product has the
    same size is ranked in many tasks.
    """
    sizes = settled(df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")), "sizes")
    runs = [(r["n_rows"], r["n"]) for r in sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n_rows").desc()).collect()]
    dealt, before = [], 0
    for (size, first, cycle), (_, n) in zip(fold_runs(runs, n_folds), runs, strict=True):
        dealt.append((size, before, first, cycle))
        before += n
    table = df.sparkSession.createDataFrame(dealt, "n_rows long, _before long, _first array<int>, _cycle array<int>")
    bucket = F.struct((-F.col("n_rows")).alias("size"), F.floor(F.col(group) / 65536).alias("block"))
    ranked = global_rank(sizes, bucket, [F.col("n_rows").desc(), group], "_rank").join(table, "n_rows")
    place, head = F.col("_rank") - 1 - F.col("_before"), F.size("_first")
    fold = F.when(place < head, F.get("_first", place.cast("int"))).otherwise(F.get("_cycle", ((place - head) % n_folds).cast("int")))
    return ranked.select(group, "n_rows", fold.alias("fold"))


def with_group_folds(df: DataFrame, n_folds: int, group: str = PRODUCT) -> DataFrame:
    folds, _ = broadcast_if_small(group_folds(df, n_folds, group).select(group, "fold"))
    return df.join(folds, group)


def with_row_folds(df: DataFrame, n_folds: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Ungrouped folds from a hash uniform per row."""
    u = hash_uniform(seed, "fold", *[F.col(k) for k in keys])
    return df.withColumn("fold", F.floor(u * n_folds).cast("int"))
