"""Distributed building blocks: size-checked broadcasts, global ranks, exact samples, permutations,
exact percentiles, histograms. None of them sorts or collects a whole table in one task."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from ripplecart.config import checkpoint_dir
from ripplecart.functions.scalars import hash_uniform

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/ripplecart-{spark.sparkContext.applicationId}"


def settled(df: DataFrame, name: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table that several jobs read to the shared checkpoint folder, and read it back.

    Like ``checkpoint()`` it cuts the lineage and survives lost executors, but it computes the rows
    once instead of twice, keeps column pruning and filter pushdown, and tells the planner real
    sizes. (Caches inside caches would also make every later plan carry all earlier ones.)
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> None:
    """Delete the settled tables of this application; frames built on them become unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Settle and measure ``df``; hint a broadcast only up to ``max_rows`` rows and BROADCAST_BYTES.

    Returns the (possibly hinted) table and whether it was small. Above either bound the caller's
    join stays an ordinary shuffled join.
    """
    df = settled(df, "side")
    small = has_at_most(df, max_rows) and row_bytes(df) <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), small


def row_bytes(table: DataFrame) -> int:
    """About the bytes of a table's rows in memory: 8 per number, texts and lists at their length."""

    def size(field: StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, ArrayType):
            return F.greatest(F.size(c), F.lit(0)) * 8 + 24
        if isinstance(field.dataType, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 24
        return F.lit(8)

    per_row = sum((size(f) for f in table.schema.fields), F.lit(16))
    return table.agg(F.coalesce(F.sum(per_row.cast("bigint")), F.lit(0))).first()[0]


def has_at_most(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a saved table is small enough to broadcast; stops counting beyond the bound."""
    return table.limit(max_rows + 1).count() <= max_rows


def uneven_keys(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """The keys of ``rows`` that ``others`` does not hold exactly once: (_key, _times), without null.

    Only keys are exchanged, equal ones of a task as one; a hash table counts them, nothing is sorted.
    """
    ours = rows.select(F.col(key).alias("_key"), F.lit(0).alias("n"), F.lit(True).alias("ours"))
    theirs = others.select(F.col(other_key).alias("_key"), F.lit(1).alias("n"), F.lit(False).alias("ours"))
    both = ours.unionAll(theirs).filter(F.col("_key").isNotNull())
    counts = both.groupBy("_key").agg(F.sum("n").alias("_times"), F.max("ours").alias("ours"))
    return counts.filter(F.col("ours") & (F.col("_times") != 1)).select("_key", "_times")


def joined_rows(rows: DataFrame, key: str, uneven: DataFrame) -> DataFrame:
    """``rows`` as an inner join with the other table leaves them, none of whose columns are wanted.

    ``uneven`` are the saved `uneven_keys`: their rows are dropped or repeated, all others pass where they lie. A table of
    uneven keys of any size will do; beyond a broadcast it is an ordinary shuffled join.
    """
    rows = rows.filter(F.col(key).isNotNull())
    if uneven.isEmpty():
        return rows
    times = F.coalesce(F.col("_times"), F.lit(1)).cast("int")
    small = F.broadcast(uneven) if has_at_most(uneven) and row_bytes(uneven) <= BROADCAST_BYTES else uneven
    met = rows.join(small, F.col(key) == F.col("_key"), "left")
    return met.select(*[met[c] for c in rows.columns], F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def global_rank(
    df: DataFrame, bucket: Column, order: Sequence[Column | str], name: str, *, bounded: bool = False
) -> DataFrame:
    """1-based rank over the whole table without one global sort.

    ``bucket`` must not decrease along ``order``. Rows are ranked inside their bucket and shifted by
    the number of rows in earlier buckets. With ``bounded=True`` the caller vouches that the number
    of buckets is a constant, so the table of shifts is broadcast.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        rows.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        rows.withColumn("_r", inside)
        .join(F.broadcast(shifts) if bounded else shifts, "_bucket")
        .withColumn(name, F.col("_r") + F.col("_shift"))
        .drop("_bucket", "_r", "_shift")
    )


def hash_rank(
    df: DataFrame, keys: Sequence[str], name: str, *, seed: int, tag: str, buckets: int = 65536
) -> DataFrame:
    """Rank of every row in a seeded random order; ``keys`` must identify a row."""
    u = f"_u_{name}"
    rows = df.withColumn(u, hash_uniform(seed, tag, *[F.col(k) for k in keys]))
    bucket = F.floor(F.col(u) * buckets)
    return global_rank(rows, bucket, [u, *keys], name, bounded=True).drop(u)


def sample_exact(
    df: DataFrame, keys: Sequence[str], n: int, *, seed: int, tag: str = "sample", buckets: int = 65536
) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: the n smallest hash uniforms.

    A histogram of the uniforms finds the bucket in which the n-th row falls; every earlier bucket
    is kept by a plain filter and only that one bucket is sorted.
    """
    rows = df.withColumn("_u", hash_uniform(seed, tag, *[F.col(k) for k in keys]))
    rows = rows.withColumn("_b", F.floor(F.col("_u") * buckets))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(upto))
    cut = hist.filter(F.col("_cum") >= n).agg(
        F.min_by(F.struct("_b", (F.lit(n) - F.col("_cum") + F.col("_n")).alias("left")), "_b").alias("c")
    )
    cut_b = F.coalesce(cut.select(F.col("c._b")).scalar(), F.lit(buckets))
    whole = rows.filter(F.col("_b") < cut_b)
    edge = (
        rows.filter(F.col("_b") == cut_b)
        .withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_u", *keys)))
        .filter(F.col("_r") <= cut.select(F.col("c.left")).scalar())
        .drop("_r")
    )
    return whole.unionByName(edge).drop("_u", "_b")


ROUNDS = 8
#: Distinct values up to which a permuted column is looked up in its sorted runs instead of joined by rank.
RUNS = 4096


def permutation_keys(seed: int, perm_id: int) -> list[int]:
    """One 28-bit key per round."""
    return [int(hashlib.md5(f"{seed}|perm|{perm_id}|{r}".encode()).hexdigest()[:7], 16) for r in range(ROUNDS)]


def factors(n: int) -> tuple[int, int]:
    """a and b with a * b >= n as tightly as possible, the cube root of n <= a <= its square root; the largest such a."""
    low, high = 1, math.isqrt(n)
    while (low + 1) ** 3 <= n:
        low += 1
    a = np.arange(low, max(high, low) + 1, dtype=np.int64)
    excess = -n % a
    best = int(a[::-1][excess[::-1].argmin()])
    return best, -(-n // best)


def permuted(k: np.ndarray, n: int, keys: Sequence[int]) -> np.ndarray:
    """A keyed permutation of 0..n-1, evaluated at k: a Feistel network on Z_a x Z_b.

    A value beyond n goes through the network again until it falls below n, which keeps the map one-to-one; at most
    a * b - n places lie beyond.
    """
    a, b = factors(max(n, 1))

    def mix(x: np.ndarray, key: int) -> np.ndarray:
        x = (x * 1_103_515_245 + key) % 2_147_483_647
        x = ((x ^ (x >> 15)) * 1_664_525) % 2_147_483_647
        return x ^ (x >> 13)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = np.divmod(x, b)
        for i, key in enumerate(keys):
            if i % 2 == 0:
                left = (left + mix(right, key)) % a
            else:
                right = (right + mix(left, key)) % b
        return left * b + right

    out = network(np.asarray(k, np.int64))
    while (beyond := out >= n).any():
        out[beyond] = network(out[beyond])
    return out


def _permuted_ranks(n: int, keys: list[list[int]], starts: np.ndarray | None, values: pa.Array | None, names: list[str]):
    """The rank, or with sorted runs the value, that each permutation sends to a row."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.asarray(batch.column("_k"))
            out = [permuted(k, n, one) for one in keys]
            made = [pa.array(j) if starts is None else values.take(pa.array(np.searchsorted(starts, j, "right") - 1)) for j in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return send


def permuted_columns(df: DataFrame, keys: Sequence[str], column: str, perm_ids: Sequence[int], *, seed: int, buckets: int = 65536) -> tuple[DataFrame, list[str]]:
    """``df`` with one more column per permutation of ``column`` over all rows, and the names of these columns.

    The rows are ranked once, by the column's value and then by hash. Every permutation is arithmetic on that rank: a
    row receives the value at the rank that the permutation sends its own to. A column with up to RUNS distinct values is
    a step function of the rank, so all permutations come from one pass; otherwise each is a join by rank.
    ``keys`` must identify a row.
    """
    u = hash_uniform(seed, "rank", *[F.col(k) for k in keys])
    rows = df.withColumn("_u", u)
    bucket = F.struct(F.col(column).alias("value"), F.floor(F.col("_u") * buckets).alias("part"))
    ranked = global_rank(rows, bucket, [F.col(column).asc_nulls_first(), "_u", *keys], "_rank").drop("_u")
    ranked = settled(ranked.withColumn("_k", F.col("_rank") - 1).drop("_rank"), "ranked")
    runs = ranked.groupBy(column).agg(F.min("_k").alias("start"))
    few = runs.limit(RUNS + 1).collect()
    n, names = ranked.count(), [f"_perm{i}" for i in perm_ids]
    key_lists = [permutation_keys(seed, i) for i in perm_ids]
    kind = df.schema[column].dataType
    if len(few) <= RUNS:
        few.sort(key=lambda r: r["start"])
        values = pa.array([r[column] for r in few], to_arrow_type(kind))
        send = _permuted_ranks(n, key_lists, np.array([r["start"] for r in few], np.int64), values, names)
        schema = StructType([*ranked.schema.fields, *[StructField(c, kind) for c in names]])
        return settled(ranked.mapInArrow(send, schema).drop("_k"), "permuted"), names
    schema = StructType([*ranked.schema.fields, *[StructField(c, LongType()) for c in names]])
    out = ranked.mapInArrow(_permuted_ranks(n, key_lists, None, None, names), schema)
    for c in names:
        out = out.withColumnRenamed(c, "_j").join(ranked.select(F.col("_k").alias("_j"), F.col(column).alias(c)), "_j").drop("_j")
    return settled(out.drop("_k"), "permuted"), names


def permute_column(df: DataFrame, keys: Sequence[str], column: str, *, seed: int, perm_id: int = 0) -> DataFrame:
    """Shuffle one column over the whole table."""
    table, (name,) = permuted_columns(df, keys, column, [perm_id], seed=seed)
    return table.drop(column).withColumnRenamed(name, column).select(*df.columns)


def ordered_positions(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """0-based position of each row in its group by ``order``, which must decide between all rows of a group.

    The rows are dealt out by ranges of (group, order) and sorted inside a range; a position is the place in the range
    plus the group's rows in earlier ranges. A group of any size spreads over as many tasks as it has ranges.
    """
    ranges = settled(
        df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()), "ranges"
    )
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    shifts = counts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (
        ranges.withColumn("_part", part)
        .join(shifts, [group, "_part"])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .select(*df.columns, name)
    )


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): the distinct values of each column as text, null included, with their rows.

    One exchange for all columns: rows are turned into (column, value) pairs that are counted before they are sent.
    """
    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        value = F.col(c) + F.lit(0.0) if isinstance(kind, (DoubleType, FloatType)) else F.col(c)  # one zero
        return value.cast("string")

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def block_pairs(rows: DataFrame, group: str, key: str, vector: str, block: int) -> DataFrame:
    """All pairs of blocks within each group: (a_ids, a_vecs, b_ids, b_vecs).

    A group is cut by hash into blocks of about ``block`` rows. A block is one row with its sorted
    keys and its vectors end to end; each unordered pair of blocks, a block with itself included,
    is one row shuffled on (group, block, block). For comparing everything with everything in a
    group as matrix products, without a row per pair and without one task per group.
    """
    sized = rows.join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    m = F.ceil(F.col("_n") / block).cast("int")
    blocked = sized.select(group, key, vector, m.alias("m"), F.pmod(F.xxhash64(key), m).cast("int").alias("blk"))
    item = F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))
    blocks = (
        blocked.groupBy(group, "m", "blk")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(group, "m", "blk", F.col("items.id").alias("ids"), F.flatten("items.v").alias("vecs"))
    )
    everyone = F.sequence(F.lit(0), F.col("m") - 1)
    left = blocks.select(
        group, F.col("blk").alias("i"), F.explode(F.filter(everyone, lambda j: j >= F.col("blk"))).alias("j"),
        F.col("ids").alias("a_ids"), F.col("vecs").alias("a_vecs"),
    )
    right = blocks.select(
        group, F.explode(F.filter(everyone, lambda i: i <= F.col("blk"))).alias("i"), F.col("blk").alias("j"),
        F.col("ids").alias("b_ids"), F.col("vecs").alias("b_vecs"),
    )
    return left.join(right, [group, "i", "j"]).select("a_ids", "a_vecs", "b_ids", "b_vecs")


def percentiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    *,
    approximate: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Percentiles with linear interpolation, one row per group and probability: (by..., p, q).

    A bounded quantile sketch brackets every requested rank; a second pass counts the rows below the
    bracket and ranks only the distinct values inside it. The result is exact, while no task ever
    ranks more than a bracket (about 8 / ``accuracy`` of a group, or a group of ``accuracy`` rows). ``approximate=True`` returns the
    sketch's own answer from a single pass.
    """
    if not by:
        one_group = df.select(F.lit(0).alias("_all"), value)
        return percentiles(
            one_group, value, probs, ["_all"], approximate=approximate, accuracy=accuracy
        ).drop("_all")
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if approximate:
        return (
            rows.groupBy(*by)
            .agg(F.percentile_approx("_v", list(map(float, probs)), accuracy).alias("_q"))
            .select(*by, F.posexplode("_q").alias("_i", "q"))
            .withColumn("p", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1))
            .select(*by, "p", "q")
        )
    margin = 3.0 / accuracy
    asked = [float(p) for p in probs]
    ends = [max(p - margin, 0.0) for p in asked] + [min(p + margin, 1.0) for p in asked]
    k = len(asked)
    whole = F.col("_n") <= accuracy  # a margin of the sketch's error is under one rank: take all rows
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_e"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    spans = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"),
                F.when(whole | F.lit(p - margin <= 0), F.col("_min")).otherwise(F.col("_e")[i]).alias("lo"),
                F.when(whole | F.lit(p + margin >= 1), F.col("_max")).otherwise(F.col("_e")[k + i]).alias("hi"),
            )
            for i, p in enumerate(asked)
        ]
    )
    brackets, _ = broadcast_if_small(sketch.select(*by, "_n", spans.alias("_spans")))
    joined = rows.join(brackets, list(by))
    seen = (
        joined.select(*by, "_v", "_n", F.explode("_spans").alias("s"))
        .filter(F.col("_v") <= F.col("s.hi"))
        .select(
            *by, F.col("s.p").alias("p"), "_n",
            # everything under the bracket is one entry, so the partial sums collapse it at once
            F.when(F.col("_v") >= F.col("s.lo"), F.col("_v")).alias("_v"),
        )
        .groupBy(*by, "p", "_n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy(*by, "p").orderBy(F.col("_v").asc_nulls_first())
    ranked = seen.withColumn("_end", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("p") * (F.col("_n") - 1)
    first, last = F.floor(at), F.ceil(at)
    covers = lambda r: (F.col("_end") - F.col("_c") <= r) & (r < F.col("_end"))
    missed = F.raise_error(F.lit("a percentile lies outside its bracket; raise the accuracy")).cast("double")
    at_rank = lambda r: F.coalesce(F.max(F.when(covers(r), F.col("_v"))), missed)
    return (
        ranked.groupBy(*by, "p", "_n")
        .agg(at_rank(first).alias("_a"), at_rank(last).alias("_b"))
        .select(*by, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - first)).alias("q"))
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins over [min, max], the last bin closed: (bin, bin_start, n)."""
    rows = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    ext = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("m")).scalar()
    width = (ext["hi"] - ext["lo"]) / F.lit(bins)
    pos = F.coalesce(F.try_divide(F.col("v") - ext["lo"], ext["hi"] - ext["lo"]), F.lit(0.0))
    return (
        rows.select(
            F.least(F.floor(pos * bins), F.lit(bins - 1)).cast("int").alias("bin"),
            ext["lo"].alias("lo"),
            width.alias("width"),
        )
        .groupBy("bin", "lo", "width")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), "n")
    )
