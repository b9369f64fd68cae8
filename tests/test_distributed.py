import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplecart.functions import distributed as D
from ripplecart.functions.distributed import settled
from ripplecart.functions.scalars import hash_uniform, normal_draw, standardised
from ripplecart.sources.retail_views import RetailViews

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("accuracy", [5, 40, 10_000])
def test_percentiles_are_exact_for_any_sketch_accuracy(spark, accuracy):
    rng = np.random.default_rng(1)
    groups = {"lognormal": rng.lognormal(0, 3, 4000), "ties": rng.integers(0, 4, 3001).astype(float), "one": np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("lognormal", None)], "g string, v double")
    got = {(r.g, r.p): r.q for r in D.percentiles(df.repartition(7), "v", PROBS, ["g"], accuracy=accuracy).collect()}
    for g, vs in groups.items():
        for p in PROBS:
            assert got[g, p] == pytest.approx(np.quantile(vs, p), rel=1e-12), (g, p)


@pytest.mark.parametrize("n", [1, 2, 99, 100, 101, 102, 1066, 1231])
def test_percentiles_around_the_sketch_size(spark, n):
    vs = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(float(v),) for v in vs], "v double").repartition(3)
    for accuracy in (100, 1000):
        got = {r.p: r.q for r in D.percentiles(df, "v", PROBS, accuracy=accuracy).collect()}
        assert got == pytest.approx({p: np.quantile(vs, p) for p in PROBS}, rel=1e-12)


def test_percentiles_without_groups_and_by_sketch(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    assert [r.q for r in D.percentiles(df, "v", [0.5]).collect()] == [500.5]
    assert [r.q for r in D.percentiles(df, "v", [0.5], approximate=True).collect()][0] == pytest.approx(500, abs=2)


def test_global_rank_equals_one_global_sort(spark):
    df = spark.range(500).withColumn("u", hash_uniform("x", F.col("id")))
    ranked = D.global_rank(df, F.floor(F.col("u") * 16), ["u", "id"], "r", bounded=True).collect()
    want = {r.id: i + 1 for i, r in enumerate(sorted(ranked, key=lambda r: (r.u, r.id)))}
    assert {r.id: r.r for r in ranked} == want


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900])
def test_sample_has_exactly_n_rows(spark, n):
    df = spark.range(500)
    got = [r.id for r in D.sample_exact(df, ["id"], n, seed=3, buckets=8).collect()]
    assert len(got) == len(set(got)) == min(n, 500)
    again = [r.id for r in D.sample_exact(df.repartition(9), ["id"], n, seed=3, buckets=1024).collect()]
    assert sorted(got) == sorted(again)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 400, 1009])
def test_permutation_network_is_one_to_one(n):
    a, b = D.factors(n)
    assert n <= a * b and a <= max(np.sqrt(n), 1)
    seen = [D.permuted(np.arange(n), n, D.permutation_keys(1, i)) for i in range(3)]
    assert all(sorted(p.tolist()) == list(range(n)) for p in seen)
    if n > 90:
        assert not (seen[0] == seen[1]).all() and abs(np.corrcoef(seen[0], np.arange(n))[0, 1]) < 0.35


def test_permutation_network_has_no_preferred_places():
    hits = np.zeros((10, 10))
    for i in range(3000):
        p = D.permuted(np.arange(10), 10, D.permutation_keys(7, i))
        hits[np.arange(10), p] += 1
    assert abs(hits / 3000 - 0.1).max() < 0.04


@pytest.mark.parametrize("distinct", [2, 5000])
def test_permutations_come_from_one_ranking(spark, distinct):
    n = 6000 if distinct > 2 else 400
    df = spark.range(n).withColumn("t", (F.col("id") * 7 % distinct).cast("double") if distinct > 2 else (F.col("id") < 100).cast("int"))
    table, names = D.permuted_columns(df.repartition(6), ["id"], "t", range(3), seed=1)
    rows = table.collect()
    assert len({r.id for r in rows}) == n
    for name in names:
        assert sorted(r[name] for r in rows) == sorted(r.t for r in rows)
    assert len({tuple(r[name] for r in sorted(rows, key=lambda r: r.id)) for name in names}) == 3
    if distinct == 2:
        for name in names:
            assert 10 < sum(r[name] for r in rows if r.id < 100) < 45
        once = {r.id: r.t for r in D.permute_column(df, ["id"], "t", seed=1, perm_id=2).collect()}
        assert once == {r.id: r[names[2]] for r in rows}


def test_positions_span_the_ranges_of_a_group(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("string").alias("g"), F.md5(F.col("id").cast("string")).alias("v"))
    got = D.ordered_positions(df.repartition(5), "g", ["v"], "pos").collect()
    for g in ("true", "false"):
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.pos)] == sorted(r.v for r in got if r.g == g)


def test_distinct_pairs_take_one_exchange(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, None), (2, 1.5, "a")], "k int, x double, s string")
    pairs = D.distinct_pairs(df, ["k", "x", "s"])
    assert {(r.column, r.value): r.n for r in pairs.collect()} == {("k", "1"): 2, ("k", "2"): 1, ("x", "0.0"): 2, ("x", "1.5"): 1, ("s", "a"): 2, ("s", None): 1}
    plan = D.distinct_pairs(df, ["k", "x", "s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 4)], "v double")
    got = {r.bin: (r.bin_start, r.n) for r in D.histogram(df, F.col("v"), 4).collect()}
    assert got == {0: (0.0, 1), 1: (1.0, 1), 2: (2.0, 1), 3: (3.0, 3)}
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r.bin, r.n) for r in D.histogram(flat, F.col("v"), 5).collect()] == [(0, 2)]


def test_uniforms_and_normals(spark):
    df = spark.range(20000).select(hash_uniform(1, F.col("id")).alias("u"), normal_draw(1, F.col("id")).alias("z"))
    m = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev_samp("z")).first()
    assert m[0] == pytest.approx(0.5, abs=0.01) and 0 <= m[1] and m[2] < 1
    assert m[3] == pytest.approx(0, abs=0.03) and m[4] == pytest.approx(1, abs=0.03)


def test_standardised_with_either_ddof(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "v double")
    x = np.array([1.0, 2.0, 6.0])
    for ddof in (0, 1):
        got = [r[0] for r in df.select(standardised(df, F.col("v"), ddof)).collect()]
        assert got == pytest.approx(list((x - x.mean()) / (x.std(ddof=ddof) + 1e-8)))


def test_settled_tables_drop_their_lineage(spark):
    df = D.settled(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10
    hinted, small = D.broadcast_if_small(df, max_rows=9)
    assert not small and "ResolvedHint" not in hinted._jdf.queryExecution().logical().toString()
    assert D.broadcast_if_small(df, max_rows=10)[1]


def test_a_task_reads_a_bounded_part_of_a_large_table(spark, tmp_path):
    """Before, a scan was cut by cores into up to 128 MB a task, and a shuffle kept its parts however large the lines were."""
    from ripplecart.config import TASK_BYTES, prepare_session
    from ripplecart.plans.workbench import Workbench

    path = str(tmp_path / "lineitem.parquet")
    spark.range(6_000_000).select(F.rand(1).alias("a")).coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(path)
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    keys.append("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys[:2]:
            spark.conf.set(k, "128m")
        prepare_session(spark)
        read = spark.read.parquet(path).select(F.input_file_block_length()).distinct().collect()
        assert len(read) and max(r[0] for r in read) <= TASK_BYTES
        spark.conf.set(keys[1], "1m")
        assert prepare_session(spark).conf.get(keys[1]) == "1m"  # a smaller setting stays
        Workbench(spark, str(tmp_path))
        assert int(spark.conf.get(keys[2])) == spark.read.parquet(path).rdd.getNumPartitions() > 4
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_met_by_an_inner_join_are_known_from_the_keys_alone(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1, 1, 2, 3, 3, None, 4, 5])], "k bigint, i int").repartition(3)
    for others in ([1, 2, 2, 2, 3, None, 9, 9], [1, 2, 3, 4, 5], [], [None]):
        orders = spark.createDataFrame([(o,) for o in others], "o bigint")
        uneven = settled(D.uneven_keys(rows, "k", orders, "o"))
        want = sorted(rows.join(orders, F.col("k") == F.col("o")).select("k", "i").collect())
        assert sorted(D.joined_rows(rows, "k", uneven).collect()) == want, others
        assert {r["_key"]: r["_times"] for r in uneven.collect()} == {k: others.count(k) for k in range(1, 6) if others.count(k) != 1}


def test_lines_of_many_orders_are_not_exchanged_where_no_household_is_wanted(spark, tmp_path):
    tables = "/root/testdata/sf0.001"
    for name in ("part", "supplier", "nation"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines, orders = (spark.read.parquet(f"{tables}/{name}.parquet") for name in ("lineitem", "orders"))
    lines.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 50 != 7, F.col("l_orderkey"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = orders.filter(F.col("o_orderkey") % 11 != 3)  # lines without an order, and orders that are there twice
    kept.unionAll(kept.filter(F.col("o_orderkey") % 13 == 5)).write.parquet(f"{tmp_path}/orders.parquet")
    views = RetailViews(spark, str(tmp_path), many_orders=0)
    whole, narrow = views.transactions().drop("household_key"), views.transactions(households=False)
    assert whole.columns == narrow.columns and 0 < narrow.count() < lines.count()
    assert whole.exceptAll(narrow).isEmpty() and narrow.exceptAll(whole).isEmpty()
    exact = RetailViews(spark, tables, many_orders=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact.transactions(households=False).select("BASKET_ID")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "orders" not in plan and "o_orderkey" not in plan and plan.count("Join") == 3  # part, supplier, nation
