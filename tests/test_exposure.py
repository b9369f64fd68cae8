import random

import pytest
from pyspark.sql import functions as F

from ripplecart.operators import exposure as X
from ripplecart.plans.workbench import Workbench

PANEL = "STORE_ID bigint, PRODUCT_ID bigint, WEEK_NO int, promo_any int, units_sold double, discount_rate double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for s in (1, 2):
        for p in range(1, 9):
            for w in range(1, 8):
                if rng.random() < 0.75:  # gaps in the panel
                    out.append((s, p, w, int(rng.random() < 0.4), float(rng.randint(0, 5)), rng.random()))
    return out + out[:5]  # duplicate rows add up


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(6)
    out = []
    for g in ("sub", "comp"):
        for a in range(1, 8):
            for b in range(a + 1, 8):  # product 8 is outside both graphs
                if rng.random() < 0.5:
                    w = rng.random()
                    out += [(g, a, b, w), (g, b, a, w)]
    return out


def brute(rows, edges, graph, value, weight=lambda w: w):
    out = {}
    for s, p, w, *_ in rows:
        num = den = 0.0
        n = 0
        for g, src, dst, ew in edges:
            if g != graph or src != p:
                continue
            for r in rows:
                if r[0] == s and r[2] == w and r[1] == dst:
                    num += weight(ew) * value(r)
                    den += weight(ew)
                    n += 1
        out[s, p, w] = (num, den, n)
    return out


@pytest.fixture(scope="module")
def frames(spark, rows, edge_rows):
    panel = spark.createDataFrame(rows, PANEL)
    edges = spark.createDataFrame(edge_rows, "graph string, src bigint, dst bigint, w double")
    return panel, edges


@pytest.mark.parametrize("denominator", ["direct", "interval"])
@pytest.mark.parametrize("block_rows", [1_000_000, 6])
@pytest.mark.parametrize("treatment, at", [("promo_any", 3), ("discount_rate", 5)])
def test_exposures_match_brute_force(frames, rows, edge_rows, denominator, block_rows, treatment, at):
    panel, edges = frames
    got = X.add_exposures(panel, edges, treatment, denominator=denominator, block_rows=block_rows).collect()
    assert len(got) == len(rows)
    for graph, prefix in X.CHANNELS.items():
        want = brute(rows, edge_rows, graph, lambda r: r[at])
        for r in got:
            num, den, n = want[r.STORE_ID, r.PRODUCT_ID, r.WEEK_NO]
            assert r[f"{prefix}_sum"] == pytest.approx(num, abs=1e-9)
            assert r[f"{prefix}_weighted"] == pytest.approx(num / den if n else 0.0, abs=1e-9)


def test_features_equal_binary_exposure_and_mean_units(frames, rows, edge_rows):
    panel, edges = frames
    feats = X.add_spillover_features(X.add_exposures(panel, edges, weight_type="binary"), edges).collect()
    units = brute(rows, edge_rows, "comp", lambda r: r[4], lambda w: 1.0)
    treated = brute(rows, edge_rows, "sub", lambda r: r[3], lambda w: 1.0)
    for r in feats:
        key = (r.STORE_ID, r.PRODUCT_ID, r.WEEK_NO)
        assert r.frac_treated_substitutes == pytest.approx(r.sub_exposure_weighted)
        assert r.n_treated_substitutes == treated[key][0]
        num, den, n = units[key]
        assert r.avg_units_complements == pytest.approx(num / den if n else 0.0)
        assert 0 <= r.comp_exposure_weighted <= 1
        if r.PRODUCT_ID == 8:
            assert r.n_treated_complements == 0 and r.sub_exposure_sum == 0


def test_switched_off_channel_is_all_zero(frames):
    panel, edges = frames
    out = X.add_exposures(panel, X.without_channel(edges, "comp"))
    assert out.filter((F.col("comp_exposure_sum") != 0) | (F.col("comp_exposure_weighted") != 0)).count() == 0
    assert out.filter(F.col("sub_exposure_sum") != 0).count() > 0


def test_presence_can_be_wider_than_the_rows(frames, rows, edge_rows):
    panel, edges = frames
    kept = panel.filter("PRODUCT_ID <= 3")
    narrow = X.add_exposures(kept, edges).agg(F.sum("sub_exposure_sum")).first()[0]
    wide = X.add_exposures(kept, edges, presence=panel).collect()
    want = brute(rows, edge_rows, "sub", lambda r: r[3])
    for r in wide:
        assert r.sub_exposure_sum == pytest.approx(want[r.STORE_ID, r.PRODUCT_ID, r.WEEK_NO][0])
    assert narrow < sum(r.sub_exposure_sum for r in wide)


def test_runs_split_at_gaps_and_changes_of_copies(spark):
    rows = [(1, 1, w) for w in (1, 2, 3, 5, 6, 6)]
    runs = X.presence_runs(spark.createDataFrame(rows, "STORE_ID bigint, PRODUCT_ID bigint, WEEK_NO int")).collect()
    assert {(r.start, r.end, r.copies) for r in runs} == {(1, 3, 1), (5, 5, 1), (6, 6, 2)}


def test_unknown_denominator(frames):
    with pytest.raises(ValueError):
        X.add_exposures(*frames, denominator="other")


def test_small_edges_cost_one_exchange_of_the_rows(frames):
    panel, edges = frames
    plan = X.add_exposures(panel, edges).select("sub_exposure_weighted")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 2  # pushed rows and receiving rows, nothing after the edge join


def _plan(frames, block_rows):
    panel, edges = frames
    layout = X.edge_layout(edges, block_rows)
    rows = panel.select("STORE_ID", "PRODUCT_ID", "WEEK_NO", F.col("promo_any").alias("t"))
    return layout, X._neighbour_sums(rows, layout, {"s": F.sum(F.col("w") * F.col("t"))})


def test_grid_of_blocks_has_a_plan_of_fixed_size(frames):
    sizes = set()
    for block_rows in (2, 6, 20):
        layout, sums = _plan(frames, block_rows)
        assert not layout.broadcast and layout.by_dst == -(-frames[1].count() // block_rows)
        text = sums._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") == 1 and "Union" not in text
        exchanges = [x for x in text.split("\n") if "Exchange hashpartitioning" in x]
        assert len(exchanges) == 3  # rows, edges, and the partial sums by receiver
        assert text.index("HashAggregate") < text.index("SortMergeJoin")
        sizes.add(len(text.split("\n")))
    assert max(sizes) - min(sizes) <= 2  # a projection more where a product has more edges than a block


def test_a_product_with_more_edges_than_a_block_is_cut_by_receiver(spark):
    hub = spark.createDataFrame([("sub", s, 1, 1.0) for s in range(2, 40)] + [("sub", 1, 2, 1.0)], "graph string, src bigint, dst bigint, w double")
    layout = X.edge_layout(hub, 10)
    assert layout.by_src == 4 and layout.by_dst == 4
    panel = spark.createDataFrame([(1, p, 1, int(p == 1), 1.0, 0.0) for p in range(1, 40)], PANEL)
    got = {r.PRODUCT_ID: r.sub_exposure_weighted for r in X.add_exposures(panel, hub, block_rows=10).collect()}
    assert got[1] == 0 and all(got[p] == 1 for p in range(2, 40))


def test_long_lists_are_multiplied_block_by_block(frames, rows, edge_rows):
    panel, edges = frames
    w = {f"w_{g}": F.when(F.col("graph") == g, F.col("w")).otherwise(0.0) for g in X.CHANNELS}
    layout = X.edge_layout(edges, 6).select("src", "dst", *[c.alias(n) for n, c in w.items()])
    sent = panel.select(*X.CELL, F.col("discount_rate").alias("_t"))
    sums = X._product_sums(sent, layout, X.BY_GRAPH, {"num": F.col("_t"), "den": F.lit(1.0)}, block_edges=9, group_rows=40)
    text = sums._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Aggregate" not in text  # no row per row and edge
    got = {(r.STORE_ID, r.src, r.WEEK_NO): r for r in sums.collect()}
    for graph in X.CHANNELS:
        for key, (num, den, _) in brute(rows, edge_rows, graph, lambda r: r[5]).items():
            r = got.get(key)
            assert (r[f"{graph}_num"] if r else 0) == pytest.approx(num) and (r[f"{graph}_den"] if r else 0) == pytest.approx(den)
    direct = {tuple(r) for r in X.add_spillover_features(panel, edges).select(*X.CELL, "n_treated_substitutes", F.round("avg_units_complements", 9)).collect()}
    assert direct == {tuple(r) for r in X.add_spillover_features(panel, edges, 6).select(*X.CELL, "n_treated_substitutes", F.round("avg_units_complements", 9)).collect()}
    one = X.without_channel(edges, "sub")
    assert X.weighted_exposure(panel, one, block_rows=6).agg(F.sum("exposure_weighted")).first()[0] == pytest.approx(
        X.weighted_exposure(panel, one).agg(F.sum("exposure_weighted")).first()[0])


def test_packed_rows_come_in_runs_of_store_and_week(spark):
    """Before, arrays kept the order of the rows, so copies of them hardly compressed."""
    rows = spark.range(600).select(
        (F.col("id") % 2).cast("int").alias("_group"), (F.col("id") * 7 % 3).alias("STORE_ID"), F.col("id").alias("PRODUCT_ID"), (F.col("id") * 5 % 4).cast("int").alias("WEEK_NO")
    )
    got = X._packed(rows.coalesce(1), "_group", ["STORE_ID", "PRODUCT_ID", "WEEK_NO"], ["STORE_ID", "WEEK_NO"]).collect()
    cells = [list(zip(r.STORE_ID, r.WEEK_NO, strict=True)) for r in got]
    assert all(c == sorted(c) for c in cells) and len(got) == 2
    made = sorted((r._group, *x) for r in got for x in zip(r.STORE_ID, r.PRODUCT_ID, r.WEEK_NO, strict=True))
    assert made == sorted((r._group, r.STORE_ID, r.PRODUCT_ID, r.WEEK_NO) for r in rows.collect())


def test_the_edges_of_a_workbench_are_not_saved_again(spark):
    class Bench(Workbench):
        substitutes = spark.createDataFrame([("sub", 1, 2, 0.5)], "graph string, src bigint, dst bigint, w double")
        complements = spark.createDataFrame([("comp", 1, 3, 1.0), ("comp", 3, 1, 1.0)], "graph string, src bigint, dst bigint, w double")

        def __init__(self):
            pass

        def _saved(self, name, build):
            raise AssertionError(f"{name} was saved")

    assert sorted(map(tuple, Bench().edges.collect())) == [("comp", 1, 3, 1.0), ("comp", 3, 1, 1.0), ("sub", 1, 2, 0.5)]
