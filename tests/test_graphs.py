import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplecart.functions.distributed import settled
from ripplecart.operators import complements as C
from ripplecart.operators import graphs as G
from ripplecart.operators import pair_grid as P
from ripplecart.operators import substitutes as S
from ripplecart.operators import walks as W
from ripplecart.operators.skipgram import SkipGramSettings, train_bucket, train_skip_gram, window_pairs


def brute_pairs(lines, k):
    baskets = {}
    for b, p in lines:
        baskets.setdefault(b, set()).add(p)
    n = {}
    for ps in baskets.values():
        for a, b in itertools.combinations(sorted(ps), 2):
            n[a, b] = n.get((a, b), 0) + 1
    return {k_: v for k_, v in n.items() if v >= k}, baskets


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(7)
    out = []
    for b in range(60):
        width = 14 if b % 7 == 0 else rng.randint(1, 6)
        out += [(b, rng.randint(1, 15)) for _ in range(width)]
    # one basket with every product, as a hot key
    return out + [(999, p) for p in range(1, 16)] * 3


@pytest.mark.parametrize("k, wide", [(1, 3), (2, 5), (4, 4), (4, 1000), (6, 1), (9, 6)])
def test_cooccurrence_is_exact_whatever_counts_as_wide(spark, lines, k, wide):
    tx = spark.createDataFrame(lines, "BASKET_ID bigint, PRODUCT_ID bigint")
    want, _ = brute_pairs(lines, k)
    got = {(r.a, r.b): r.n_ab for r in C.cooccurrence(C.basket_items(tx), k, wide).collect()}
    assert got == want


@pytest.mark.parametrize("tile, block", [(1, 5), (2, 100), (16, 4)])
def test_wide_pairs_are_complete_over_several_tiles(spark, tile, block):
    rng = random.Random(1)
    lines = [(b, p) for b in range(200) for p in rng.sample(range(1, 25), 8)]
    want, _ = brute_pairs(lines, 24)
    wide = spark.createDataFrame(lines, "BASKET_ID bigint, PRODUCT_ID bigint")
    words = C._basket_words(wide, wide.select("BASKET_ID").distinct())
    got = {(r.a, r.b) for r in C._pairs_of_wide_baskets(words, 200, 24, block, tile).collect()}
    assert set(want) <= got and all(a < b for a, b in got)
    if tile == 16:
        assert got == set(want)  # one tile: nothing but the pairs that qualify


def test_complement_weights_use_the_filtered_universe(spark, lines):
    keep = set(range(1, 11))
    tx = spark.createDataFrame(lines, "BASKET_ID bigint, PRODUCT_ID bigint")
    products = spark.createDataFrame([(p,) for p in keep], "PRODUCT_ID bigint")
    inside = [(b, p) for b, p in lines if p in keep]
    pairs, baskets = brute_pairs(inside, 3)
    marg = {p: sum(p in s for s in baskets.values()) for p in keep}
    pmi = {ab: math.log(n * len(baskets) / (marg[ab[0]] * marg[ab[1]])) for ab, n in pairs.items()}
    pmi = {ab: v for ab, v in pmi.items() if v > 0}
    top = max(pmi.values())
    got = {(r.src, r.dst): r.w for r in C.complement_edges(tx, 3, products).collect()}
    assert len(got) == 2 * len(pmi) and max(got.values()) == 1.0
    for (a, b), v in pmi.items():
        assert got[a, b] == pytest.approx(v / top) and got[b, a] == got[a, b]


def test_no_pair_reaches_the_minimum(spark):
    tx = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "BASKET_ID bigint, PRODUCT_ID bigint")
    assert C.complement_edges(tx, 10).count() == 0


def brute_substitutes(nodes, vecs, k):
    out = {}
    for src, g in nodes.items():
        scored = []
        for dst, h in nodes.items():
            if dst == src or h != g or g is None:
                continue
            if vecs is None or src not in vecs or dst not in vecs:
                w = 1.0
            else:
                a, b = vecs[src], vecs[dst]
                den = np.linalg.norm(a) * np.linalg.norm(b)
                w = max(float(a @ b) / den, 0.0) if den > 0 else 0.0
            scored.append((-round(w, 12), dst, w))
        for _, dst, w in sorted(scored)[:k]:
            if w > 0:
                out[src, dst] = max(out.get((src, dst), 0), w)
                out[dst, src] = max(out.get((dst, src), 0), w)
    return out


@pytest.fixture(scope="module")
def catalog():
    nodes = {i: ("hot" if i % 3 else "") for i in range(1, 40)}
    nodes[50] = None
    nodes[51] = "alone"
    return nodes


@pytest.mark.parametrize("k, block", [(2, 3), (5, 100), (50, 4)])
def test_substitutes_match_brute_force(spark, catalog, k, block):
    rng = np.random.default_rng(3)
    vecs = {p: rng.normal(size=4).astype(np.float32).astype(float) for p in catalog if p % 5}
    vecs[7] = np.zeros(4)
    product = spark.createDataFrame(list(catalog.items()), "PRODUCT_ID bigint, SUB_COMMODITY_DESC string")
    emb = spark.createDataFrame([(p, [float(x) for x in v]) for p, v in vecs.items()], "PRODUCT_ID bigint, embedding array<float>")
    got = {(r.src, r.dst): r.w for r in S.substitute_edges(product, emb, max_neighbors=k, block=block).collect()}
    want = brute_substitutes(catalog, vecs, k)
    assert set(got) == set(want)
    assert all(got[e] == pytest.approx(want[e], abs=1e-9) for e in want)


@pytest.mark.parametrize("k", [1, 4, 100])
def test_substitutes_without_vectors_take_the_first_ids(spark, catalog, k):
    product = spark.createDataFrame(list(catalog.items()), "PRODUCT_ID bigint, SUB_COMMODITY_DESC string")
    got = {(r.src, r.dst): r.w for r in S.substitute_edges(product, max_neighbors=k).collect()}
    assert got == brute_substitutes(catalog, None, k)


@pytest.fixture(scope="module")
def small_graph(spark):
    rows = [("comp", 1, 2, 1.0), ("comp", 2, 1, 1.0), ("comp", 2, 3, 0.5), ("comp", 3, 2, 0.5), ("comp", 3, 4, 0.2), ("comp", 4, 3, 0.2)]
    edges = spark.createDataFrame(rows, "graph string, src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "PRODUCT_ID bigint")
    return edges, nodes


def test_graph_profiles_count_isolated_nodes(small_graph):
    edges, nodes = small_graph
    s = G.graph_summary(edges, nodes).first()
    assert (s.n_nodes, s.n_edges, s.w_min, s.w_max) == (5, 3, 0.2, 1.0) and s.density == pytest.approx(6 / 20)
    deg = {(r.graph, r.PRODUCT_ID): r.degree for r in G.degrees(edges, nodes).collect()}
    assert deg["comp", 9] == 0 and deg["comp", 2] == 2 and deg["sub", 1] == 0
    assert {r.graph: r.median_degree for r in G.median_degree(edges, nodes).collect()} == {"comp": 1.0, "sub": 0.0}


def test_transitions_sum_to_one(small_graph):
    rows = W.transition_table(small_graph[0]).collect()
    last = {}
    for r in rows:
        last[r.src] = max(last.get(r.src, 0), r.cum)
    assert all(v == pytest.approx(1.0) for v in last.values())


@pytest.mark.parametrize("biased", [False, True])
def test_walks_follow_edges_and_stop_at_isolated_nodes(small_graph, biased):
    edges, nodes = small_graph
    if biased:
        out = W.biased_walks(edges, nodes, 3, 8, p=0.5, q=2.0)
    else:
        out = W.unbiased_walks(edges, nodes, 3, 8)
    known = {(r.src, r.dst) for r in edges.collect()}
    walks = {r.walk_id: [int(x) for x in r.walk] for r in out.collect()}
    assert sorted(walks) == list(range(15))
    for walk in walks.values():
        assert len(walk) == (1 if walk[0] == 9 else 8)
        assert all(step in known for step in itertools.pairwise(walk))
    assert sorted(w[0] for w in walks.values()) == sorted([1, 2, 3, 4, 9] * 3)


def test_unbiased_steps_follow_the_weights(spark):
    rows = [(0, d, float(d)) for d in range(1, 11)]
    edges = spark.createDataFrame(rows + [(d, 0, w) for _, d, w in rows], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(0,)], "PRODUCT_ID bigint")
    out = W.unbiased_walks(edges, nodes, 4000, 2).select(F.col("walk")[1].cast("int").alias("d"))
    share = {r.d: r["count"] / 4000 for r in out.groupBy("d").count().collect()}
    for d in range(1, 11):
        assert share[d] == pytest.approx(d / 55, abs=0.03)


def test_biased_steps_prefer_the_way_back(spark):
    pairs = [(1, 2), (2, 3), (2, 4)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(1,)], "PRODUCT_ID bigint")
    out = W.biased_walks(edges, nodes, 3000, 3, p=0.25, q=1.0)
    back = out.filter(F.col("walk")[2] == "1").count() / 3000
    assert back == pytest.approx(4 / 6, abs=0.04)


def test_biased_steps_weigh_near_and_far_neighbours(spark):
    # from 1 to 2; there 1 is the way back, 3 a common neighbour, 4 and 5 are far; weights differ
    pairs = [(1, 2, 1.0), (1, 3, 1e-9), (2, 3, 2.0), (2, 4, 1.0), (2, 5, 3.0)]
    edges = spark.createDataFrame(pairs + [(b, a, w) for a, b, w in pairs], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(1,)], "PRODUCT_ID bigint")
    p, q = 0.5, 4.0
    weight = {1: 1 / p, 3: 2.0, 4: 1 / q, 5: 3 / q}
    for trials in (1, 4):
        out = W.biased_walks(edges, nodes, 4000, 3, p=p, q=q, trials=trials)
        third = [int(r.walk[2]) for r in out.collect() if r.walk[1] == "2"]
        assert len(third) > 3990
        for node, w in weight.items():
            assert third.count(node) / len(third) == pytest.approx(w / sum(weight.values()), abs=0.03)


def test_a_round_of_biased_steps_never_meets_neighbour_lists(spark):
    hub = [(0, d, 1.0) for d in range(1, 400)]
    edges = spark.createDataFrame(hub + [(b, a, w) for a, b, w in hub], "src bigint, dst bigint, w double")
    slots = W._slots(edges)
    assert slots.filter("src = 0").groupBy("slot").count().agg(F.max("count")).first()[0] <= 3
    out = W.biased_walks(edges, spark.createDataFrame([(0,), (1,)], "PRODUCT_ID bigint"), 3, 5, p=1.0, q=0.5)
    assert all(len(r.walk) == 5 for r in out.collect()) and out.count() == 6


def _two_cliques(size=12):
    groups = [list(range(size)), list(range(100, 100 + size))]
    return groups, [(a, b) for g in groups for a in g for b in g if a != b] + [(0, 100), (100, 0)]


@pytest.mark.parametrize("block_nodes", [1000, 7])
def test_skip_gram_loss_falls_and_neighbours_are_near(spark, block_nodes):
    groups, pairs = _two_cliques()
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(n,) for g in groups for n in g], "PRODUCT_ID bigint")
    walks = settled(W.unbiased_walks(edges, nodes, 20, 12), "walks")
    trained = train_skip_gram(walks, SkipGramSettings(dim=16, epochs=4, step=0.05), block_nodes=block_nodes)
    assert trained.blocks == (1 if block_nodes == 1000 else 4)
    assert trained.losses[-1] < 0.95 * trained.losses[0]
    vectors = {r.PRODUCT_ID: np.array(r.embedding) for r in trained.vectors.collect()}
    assert sorted(vectors) == sorted(n for g in groups for n in g)
    unit = {k: v / np.linalg.norm(v) for k, v in vectors.items()}
    side = {n: i for i, g in enumerate(groups) for n in g}
    nearest = {a: max((b for b in unit if b != a), key=lambda b: unit[a] @ unit[b]) for a in unit}
    assert sum(side[a] == side[b] for a, b in nearest.items()) >= len(unit) - 1


def test_window_pairs_stay_in_their_walk_and_reach():
    node, walk = np.array([5, 6, 7, 8, 1, 2]), np.array([0, 0, 0, 0, 1, 1])
    centre, context = window_pairs(node, walk, 3, 0)
    found = set(zip(centre.tolist(), context.tolist()))
    place = {n: i for i, n in enumerate(node.tolist())}
    assert all((a in (1, 2)) == (b in (1, 2)) and 0 < abs(place[a] - place[b]) <= 3 for a, b in found)
    assert {(a, b) for a, b in found if abs(place[a] - place[b]) == 1} >= {(5, 6), (6, 5), (6, 7), (7, 6), (7, 8), (8, 7), (1, 2), (2, 1)}
    assert len(window_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64), 3, 0)[0]) == 0


def test_bucket_training_lowers_its_loss():
    rng = np.random.default_rng(1)
    inputs, outputs = ((rng.random((6, 8)) - 0.5).astype(np.float32) / 8 for _ in range(2))
    centre, context = np.array([0, 1, 2] * 200), np.array([1, 0, 2] * 200)
    losses = [train_bucket(inputs, outputs, np.ones(6), centre, context, 0.1, 3, rng) for _ in range(8)]
    assert losses[-1] < 0.7 * losses[0]


@pytest.mark.parametrize("wide_basket", [1000, 2])
def test_cooccurrence_reads_its_items_once(spark, wide_basket):
    """Before, the items' plan ran three to five times."""
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            rows.add(len(pdf))
            yield pdf

    items = spark.createDataFrame([(b, p) for b in range(6) for p in range(b % 3 + 2)], "BASKET_ID long, PRODUCT_ID long")
    got = {(r.a, r.b): r.n_ab for r in C.cooccurrence(items.mapInPandas(seen, items.schema), 2, wide_basket).collect()}
    assert got == {(0, 1): 6, (0, 2): 4, (1, 2): 4, (0, 3): 2, (1, 3): 2, (2, 3): 2}
    assert rows.value == 18


def test_first_neighbours_are_made_in_tasks_by_their_number(spark):
    product = settled(spark.range(30_000).select(F.col("id").alias("PRODUCT_ID"), F.lit("s").alias("SUB_COMMODITY_DESC")))
    made = S._first_others(product, product, 50)
    per_task = [r.n for r in made.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per_task) == 30_000 * 50 and max(per_task) <= 600_000
    assert {r.dst for r in made.filter("src = 7").collect()} == set(range(51)) - {7}


def test_walks_are_the_same_whichever_side_is_broadcast(spark):
    rows = [(a, b, 1.0 + a % 3) for a in range(12) for b in range(12) if a != b and a % 4 != 3 and (a * b) % 3]
    edges = settled(spark.createDataFrame(rows, "src bigint, dst bigint, w double"))  # some nodes end a walk
    nodes = spark.range(12).select(F.col("id").alias("PRODUCT_ID"))
    walks = [{r.walk_id: list(r.walk) for r in W.unbiased_walks(edges, nodes, 2, 8, max_rows=n).collect()} for n in (1_000_000, 50)]
    assert walks[0] == walks[1] and len(walks[0]) == 24
    assert len(set(map(len, walks[0].values()))) > 1


def test_pairs_are_made_in_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(C, "MADE_PAIRS", 5000)
    items = settled(spark.range(20 * 60).select((F.col("id") % 20).alias("BASKET_ID"), F.floor(F.col("id") / 20).alias("PRODUCT_ID")))
    pairs = C._cooccurrence(items, 10, 1000)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(BASKET_ID" in text and ", 8), REPARTITION_BY_NUM" in text  # 20 * 60 * 59 / 2 = 35,400 pairs
    assert pairs.count() == 60 * 59 // 2 and pairs.filter("n_ab = 20").count() == 60 * 59 // 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_pairs_are_counted_without_exchanging_them(spark):
    """Before, 8 million pairs of a hundred baskets were exchanged by (a, b), and of many wide baskets nearly all candidates."""
    rows = spark.range(100 * 400).select((F.col("id") % 100).alias("BASKET_ID"), F.pmod(F.xxhash64("id"), F.lit(2000)).alias("PRODUCT_ID"))
    items = settled(rows.distinct())
    got = C.cooccurrence(items, 10)
    assert "hashpartitioning(a" not in _plan(got)
    want = C._cooccurrence(items, 10, 1000)
    assert "hashpartitioning(a" in _plan(want)
    assert want.count() == got.count() > 3_000 and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("k, side, sorted_pairs", [(1, 1, 5), (2, 3, 50), (3, 4, 1 << 21)])
def test_grid_weights_are_those_of_exchanged_pairs(spark, lines, monkeypatch, k, side, sorted_pairs):
    tx = spark.createDataFrame(lines + [(None, 3), (5, None)], "BASKET_ID bigint, PRODUCT_ID bigint")
    want = sorted(C.complement_edges(tx, k).collect())
    monkeypatch.setattr(C, "_grid", lambda items, wide: (side, items.select("BASKET_ID").distinct().count()))
    monkeypatch.setattr(P, "SORTED_PAIRS", sorted_pairs)
    edges = C.complement_edges(tx, k)
    got = sorted(edges.collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and max(r.w for r in got) == 1.0
    assert [r.w for r in got] == pytest.approx([r.w for r in want])
    assert "Exchange hashpartitioning" not in _plan(edges)


def test_a_grid_without_pairs_is_empty(spark, monkeypatch):
    monkeypatch.setattr(C, "_grid", lambda items, wide: (2, 2))
    tx = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "BASKET_ID bigint, PRODUCT_ID bigint")
    assert C.complement_edges(tx, 10).count() == 0 and C.complement_edges(tx, 2).count() == 0


def test_few_products_or_few_very_wide_baskets_need_no_grid(spark, monkeypatch):
    monkeypatch.setattr(C, "EXCHANGED_PAIRS", 1000)
    few = settled(spark.range(400 * 6).select((F.col("id") % 400).alias("BASKET_ID"), F.floor(F.col("id") / 400).alias("PRODUCT_ID")))
    wide = settled(spark.range(300).select((F.col("id") * 0).alias("BASKET_ID"), F.col("id").alias("PRODUCT_ID")))
    assert C._grid(few, 1000)[0] == 0 and C._grid(wide, 100)[0] == 0 and C._grid(wide, 1000)[0] == 1
