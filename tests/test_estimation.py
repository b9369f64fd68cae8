import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplecart.config import CELL, EFFECTS, StudyConfig
from ripplecart.functions.distributed import settled
from ripplecart.operators import baselines, boosting, covariates, dml, evaluate, forest, interpret, linear
from ripplecart.operators.nuisance import Nuisance, residualise


def numpy_cluster(x, e, ids):
    inv = np.linalg.pinv(x.T @ x)
    s = np.array([(x[ids == g] * e[ids == g][:, None]).sum(axis=0) for g in np.unique(ids)])
    g, (n, k) = len(s), x.shape
    return g / (g - 1) * (n - 1) / (n - k) * inv @ s.T @ s @ inv


@pytest.mark.parametrize("zero_column", [False, True])
def test_two_way_clustered_errors(spark, zero_column):
    rng = np.random.default_rng(2)
    n = 600
    c1, c2 = rng.integers(0, 20, n), rng.integers(0, 7, n)
    x = rng.normal(size=(n, 3))
    if zero_column:
        x[:, 2] = 0.0
    y = x @ [1.0, -0.5, 0.2] + rng.normal(size=20)[c1] + rng.normal(size=n)
    df = spark.createDataFrame(
        [(int(a), int(b), *map(float, r), float(v)) for a, b, r, v in zip(c1, c2, x, y)],
        "p bigint, s bigint, a double, b double, c double, y double",
    )
    fit = linear.clustered_ols(df, "y", ["a", "b", "c"], "p", "s")
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    v = numpy_cluster(x, e, c1) + numpy_cluster(x, e, c2) - numpy_cluster(x, e, c1 * 100 + c2)
    assert fit.beta == pytest.approx(beta, abs=1e-10)
    assert fit.se == pytest.approx(np.sqrt(np.diag(linear.floor_eigenvalues(v))), abs=1e-9)
    if zero_column:
        assert fit.beta[2] == 0 and fit.se[2] == pytest.approx(0, abs=1e-9)


def test_eigenvalue_floor():
    v = np.array([[1.0, 2.0], [2.0, 1.0]])  # eigenvalues 3 and -1
    assert linear.floor_eigenvalues(v) == pytest.approx(np.array([[1.5, 1.5], [1.5, 1.5]]))
    assert linear.floor_eigenvalues(np.eye(2) * 2) == pytest.approx(np.eye(2) * 2)


def test_ols_hc1(spark):
    rng = np.random.default_rng(4)
    n = 500
    x = np.column_stack([np.ones(n), rng.integers(0, 2, n), rng.integers(1, 400, n), rng.normal(size=(n, 5))])
    y = x @ rng.normal(size=8) + rng.normal(size=n) * (1 + x[:, 1])
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"x{i} double" for i in range(8)) + ", y double")
    fit = linear.ols_hc1(df, F.col("y"), [F.col(f"x{i}") for i in range(8)])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    cov = inv @ (x.T * e**2) @ x @ inv * n / (n - 8)
    assert fit.beta == pytest.approx(beta, rel=1e-7)
    assert fit.se == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-7)
    assert fit.r_squared == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())


def test_wide_cross_products_by_group(spark):
    rng = np.random.default_rng(9)
    w, y, g = rng.normal(size=(300, 4)), rng.normal(size=300), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(r.tolist(), float(v), int(k)) for r, v, k in zip(w, y, g)], "w array<double>, y double, g int").repartition(5)
    out = linear.cross_products(df, lambda c: (c["w"], c["y"][:, None], None), 4, 1, "g")
    for k in range(3):
        z = np.column_stack([w[g == k], y[g == k], np.ones((g == k).sum())])
        assert out[k] == pytest.approx(z.T @ z)


@pytest.mark.parametrize("fan", [2, 32])
def test_triangular_factors_solve_badly_conditioned_designs(spark, fan):
    rng = np.random.default_rng(4)
    n, k = 3000, 6
    u, _ = np.linalg.qr(rng.normal(size=(n, k)))
    v, _ = np.linalg.qr(rng.normal(size=(k, k)))
    x = u @ np.diag(np.logspace(0, -8, k)) @ v.T
    y = x @ rng.normal(size=k) + 1e-9 * rng.normal(size=n)
    assert np.linalg.cond(x) > 9e7
    df = spark.createDataFrame([(r.tolist(), float(t), int(i % 2)) for i, (r, t) in enumerate(zip(x, y))], "w array<double>, y double, g int").repartition(7)
    design = lambda c: (c["w"], c["y"][:, None], None)
    factors = linear.triangular_factors(df, design, k, 1, "g", fan=fan)
    assert {g: m for g, (_, m) in factors.items()} == {0: 1500, 1: 1500}
    both = linear.merged_factors([r for r, _ in factors.values()], k + 1)
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    got = linear.solve_triangular(both, k)[0][:, 0]
    assert np.linalg.norm(got - want) / np.linalg.norm(want) < 1e-6 and x @ got == pytest.approx(x @ want, abs=1e-12)
    gram = linear.solve_min_norm(x.T @ x, x.T @ y)[0]
    assert np.linalg.norm(x @ gram - y) > 10 * np.linalg.norm(x @ got - y)  # Gram sums lose it
    for g in (0, 1):
        half = np.linalg.lstsq(x[g::2], y[g::2], rcond=None)[0]
        assert x @ linear.solve_triangular(factors[g][0], k)[0][:, 0] == pytest.approx(x @ half, abs=1e-8)


def test_triangular_factors_take_collinear_and_empty_columns(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=400)
    x = np.column_stack([np.ones(400), a, 2 * a, np.zeros(400)])
    y = 1 + 5 * a + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "w array<double>, y double").repartition(3)
    (factor, n), = linear.triangular_factors(df, lambda c: (c["w"], c["y"][:, None], None), 4, 1).values()
    beta, inv = linear.solve_triangular(factor, 4)
    assert n == 400 and x @ beta[:, 0] == pytest.approx(x @ np.linalg.lstsq(x, y, rcond=None)[0]) and beta[3, 0] == 0
    assert (inv[3] == 0).all()


@pytest.fixture(scope="module")
def keyed(spark):
    rng = np.random.default_rng(11)
    rows = [
        (s, p, w, "A" if p % 2 else ("B" if p % 3 else None), float(rng.normal() + p), float(rng.random()), int(p % 3))
        for s in (1, 2) for p in range(1, 13) for w in range(1, 5)
    ]
    rows.append((1, 99, 50, "Z", 3.0, 1.0, 0))  # alone in its cell: falls back to the global mean
    return rows, spark.createDataFrame(rows, "STORE_ID bigint, PRODUCT_ID bigint, WEEK_NO int, DEPARTMENT string, y double, t double, fold int")


def test_cell_means_leave_the_own_fold_out(keyed):
    rows, df = keyed
    out = {tuple(r[c] for c in CELL): r for r in residualise(df, ["y", "t"], 3, Nuisance("cell_mean")).collect()}
    assert len(out) == len(rows)
    for s, p, w, d, y, t, f in rows:
        cell = [r for r in rows if r[3] == d and r[2] == w and r[6] != f] or [r for r in rows if r[6] != f]
        assert out[s, p, w].y_res == pytest.approx(y - np.mean([r[4] for r in cell]))
        assert out[s, p, w].t_res == pytest.approx(t - np.mean([r[5] for r in cell]))


def test_linear_nuisance_is_out_of_fold_least_squares(keyed):
    rows, df = keyed
    df = df.withColumn("w", F.array(F.col("STORE_ID").cast("double"), F.col("WEEK_NO").cast("double")))
    out = {tuple(r[c] for c in CELL): r.y_res for r in residualise(df, ["y"], 3, Nuisance("linear")).collect()}
    x = np.array([[1.0, r[0], r[2]] for r in rows])
    y, f = np.array([r[4] for r in rows]), np.array([r[6] for r in rows])
    for k in range(3):
        beta = np.linalg.lstsq(x[f != k], y[f != k], rcond=None)[0]
        for i in np.flatnonzero(f == k):
            assert out[rows[i][0], rows[i][1], rows[i][2]] == pytest.approx(y[i] - x[i] @ beta)


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_tree_nuisance_scores_every_row_once(keyed, kind):
    rows, df = keyed
    df = df.withColumn("w", F.array(F.col("STORE_ID").cast("double"), F.col("WEEK_NO").cast("double")))
    out = residualise(df, ["y"], 3, Nuisance(kind, trees=2, depth=2))
    assert out.count() == len(rows) and out.filter("y_res is null").count() == 0


def _plain_boosting(x, y, rounds, depth, leaves, step, least):
    """One model, row by row: best-first trees on the distinct values of each column."""
    score, trees = np.full(len(y), y.mean()), []

    def best(rows, g):
        found = (1e-9, None)
        for j in range(x.shape[1]):
            for c in np.unique(x[rows, j])[:-1]:
                left = x[rows, j] <= c
                if min(left.sum(), (~left).sum()) >= least:
                    gain = g[rows][left].sum() ** 2 / left.sum() + g[rows][~left].sum() ** 2 / (~left).sum() - g[rows].sum() ** 2 / len(rows)
                    if gain > found[0] * (1 + 1e-9):
                        found = (gain, (j, c))
        return found

    for _ in range(rounds):
        g = y - score
        tree = {(): np.arange(len(y))}
        cuts = {(): best(tree[()], g)}
        while len(tree) < leaves:
            at = max((k for k in tree if len(k) < depth), key=lambda k: cuts[k][0], default=None)
            if at is None or cuts[at][1] is None:
                break
            rows, (j, c) = tree.pop(at), cuts[at][1]
            for side in (True, False):
                tree[at + (side,)] = rows[(x[rows, j] <= c) == side]
                cuts[at + (side,)] = best(tree[at + (side,)], g)
        for rows in tree.values():
            score[rows] += step * g[rows].mean()
    return score


def test_boosting_equals_a_plain_single_machine_run(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 600), rng.integers(0, 30, 600), rng.integers(0, 4, 600)]).astype(float)
    y = np.sin(x[:, 1]) + x[:, 0] * (x[:, 2] > 1) + rng.normal(size=600) * 0.1
    settings = boosting.BoostSettings(rounds=6, depth=4, leaves=9, step=0.3, least_rows=15)
    want = _plain_boosting(x, y, 6, 4, 9, 0.3, 15)
    edges = [np.unique(c)[:-1] for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]).astype(np.uint8)
    start, trees = boosting.boost(bins, np.ones(600), y, settings)
    score = start + sum(t.value[t.leaf_of(bins, 4)] for t in trees)
    assert score == pytest.approx(want)
    assert max(t.split.sum() + 1 for t in trees) == 9
    # through Spark, out of fold, by model and by level
    f = rng.integers(0, 3, 600)
    df = spark.createDataFrame([(int(i), int(k), r.tolist(), float(v), float(-v)) for i, (k, r, v) in enumerate(zip(f, x, y))], "id int, fold int, w array<double>, y double, t double").repartition(3)
    for entries in (10**9, 0):
        got = boosting.boosted_predictions(df, ["y", "t"], 3, settings, task_entries=entries, keep=4).orderBy("id").toPandas()
        for k in range(3):
            s, model = boosting.boost(bins[f != k], np.ones((f != k).sum()), y[f != k], settings)
            hat = s + sum(t.value[t.leaf_of(bins[f == k], 4)] for t in model)
            assert got._hat0[f == k].to_numpy() == pytest.approx(hat, abs=1e-9)
            assert got._hat1[f == k].to_numpy() == pytest.approx(-hat, abs=1e-9)
        assert np.mean((got._hat0 - y) ** 2) < 0.5 * y.var()


def test_unknown_nuisance(keyed):
    with pytest.raises(ValueError):
        residualise(keyed[1], ["y"], 3, Nuisance("other"))


def test_label_codes_are_sorted_and_missing_is_minus_one(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("Z",), ("b",)], "DEPARTMENT string")
    got = {r.DEPARTMENT: r.DEPARTMENT_code for r in covariates.with_label_codes(df).collect()}
    assert got == {"Z": 0, "a": 1, "b": 2, None: -1}


def _greedy(sizes, n_folds):
    load, out = [0] * n_folds, {}
    for p in sorted(sizes, key=lambda p: (-sizes[p], p)):
        out[p] = load.index(min(load))
        load[out[p]] += sizes[p]
    return out


@pytest.mark.parametrize("spread", [1, 3, 60])
def test_group_folds_go_to_the_lightest_fold(spark, spread):
    rng = np.random.default_rng(5)
    sizes = {p: int(rng.integers(1, spread + 1)) for p in range(1, 90)} | {200: 700}
    df = spark.createDataFrame([(p,) for p, n in sizes.items() for _ in range(n)], "PRODUCT_ID bigint")
    got = covariates.group_folds(df, 4).collect()
    assert {r.PRODUCT_ID: r.fold for r in got} == _greedy(sizes, 4)
    assert {r.PRODUCT_ID: r.n_rows for r in got} == sizes


def test_runs_of_equal_groups_are_dealt_without_a_step_per_group():
    rng = np.random.default_rng(6)
    for _ in range(50):
        runs = sorted({int(s): int(rng.integers(1, 40)) for s in rng.integers(1, 30, 6)}.items(), reverse=True)
        sizes = {i: s for i, s in enumerate(s for s, n in runs for _ in range(n))}
        want, at = _greedy(sizes, 5), 0
        for (size, n), (same, first, cycle) in zip(runs, covariates.fold_runs(runs, 5)):
            dealt = [(first[r] if r < len(first) else cycle[(r - len(first)) % 5]) for r in range(n)]
            assert same == size and dealt == [want[at + r] for r in range(n)]
            at += n
    assert len(covariates.fold_runs([(3, 10**12), (1, 10**12)], 5)[1][1]) < 20


def test_label_codes_of_many_labels_come_from_many_ranges(spark):
    df = spark.range(3000).select(F.concat(F.lit("L"), F.md5(F.col("id").cast("string"))).alias("DEPARTMENT"), F.lit("one").alias("BRAND"))
    codes = covariates.label_codes(df.repartition(5), ["DEPARTMENT", "BRAND"]).collect()
    labels = sorted(r.value for r in codes if r.column == "DEPARTMENT")
    assert {r.value: r.code for r in codes if r.column == "DEPARTMENT"} == {v: i for i, v in enumerate(labels)}
    assert [(r.value, r.code) for r in codes if r.column == "BRAND"] == [("one", 0)]


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(21)
    rows = [
        (s, p, w, int(rng.random() < 0.3), float(rng.poisson(3)), f"D{p % 3}", f"C{p % 5}", f"S{p % 4}", "N" if p % 2 else "P")
        for s in range(1, 5) for p in range(1, 25) for w in range(1, 13)
    ]
    schema = (
        "STORE_ID bigint, PRODUCT_ID bigint, WEEK_NO int, promo_any int, units_sold double, DEPARTMENT string, "
        "COMMODITY_DESC string, SUB_COMMODITY_DESC string, BRAND string"
    )
    edges = [("sub", a, b, 1.0) for a in range(1, 25) for b in range(1, 25) if a != b and a % 4 == b % 4]
    edges += [("comp", a, b, (1 + (a + b) % 3) / 3) for a in range(1, 25) for b in range(1, 25) if abs(a - b) in (1, 5)]
    panel = settled(spark.createDataFrame(rows, schema), "panel")
    return panel, settled(spark.createDataFrame(edges, "graph string, src bigint, dst bigint, w double"), "edges")


def test_injected_effects_are_recovered_without_noise(study):
    panel, edges = study
    cfg = StudyConfig(noise_std=0.0, baseline_demand=9.0)
    made = evaluate.generate_outcome(panel, edges, cfg)
    est = dml.run_graph_dml(
        made, edges, outcome="y_synthetic", log_transform=False, min_demand_filter=None, nuisance=Nuisance("linear"), n_folds=3
    )
    got = {r.effect: r.ATE for r in est.effects.collect()}
    assert got["direct"] == pytest.approx(0.10, abs=1e-6)
    assert got["sub_spillover"] == pytest.approx(-0.05, abs=1e-6)
    assert got["comp_spillover"] == pytest.approx(0.03, abs=1e-6)
    spread = est.cate().agg(F.min("direct_cate"), F.max("direct_cate"), F.avg("sub_spillover_cate")).first()
    assert spread[0] == pytest.approx(0.10, abs=1e-5) and spread[1] == pytest.approx(0.10, abs=1e-5)
    assert spread[2] == pytest.approx(-0.05, abs=1e-5)


def test_injected_effects_are_recovered_with_noise(study):
    """Averaged over draws: four stores are too few clusters to trust a single draw's interval."""
    panel, edges = study
    options = {"outcome": "y_synthetic", "log_transform": False, "min_demand_filter": None, "nuisance": Nuisance("linear")}
    draws = {e: [] for e in EFFECTS}
    for seed in range(3):
        cfg = StudyConfig(baseline_demand=9.0, noise_std=0.2, seed=seed)
        made = evaluate.generate_outcome(panel, edges, cfg, reassign_treatment=True)
        for r in dml.run_graph_dml(made, edges, with_cate=False, **options).effects.collect():
            draws[r.effect].append(r.ATE)
    # about three standard errors of a mean of three draws
    assert np.mean(draws["direct"]) == pytest.approx(0.10, abs=0.025)
    assert np.mean(draws["sub_spillover"]) == pytest.approx(-0.05, abs=0.06)
    assert np.mean(draws["comp_spillover"]) == pytest.approx(0.03, abs=0.05)


def test_log_space_outcome_is_the_exponential_of_the_index(study):
    panel, edges = study
    cfg = StudyConfig(noise_std=0.0)
    level = evaluate.generate_outcome(panel, edges, cfg).agg(F.max("y_synthetic")).first()[0]
    log = evaluate.generate_outcome(panel, edges, cfg, log_space=True).agg(F.max("y_synthetic")).first()[0]
    assert log == pytest.approx(np.expm1(level))


def test_ablations_flag_the_excluded_effects_and_equal_separate_runs(study):
    panel, edges = study
    options = {"nuisance": Nuisance("cell_mean"), "n_folds": 3, "min_demand_filter": None}
    table = {(r.ablation, r.effect): r for r in dml.ablation_suite(panel, edges, **options).collect()}
    assert len(table) == 15
    assert {k for k, r in table.items() if r.excluded} == {("sub_only", "comp_spillover"), ("comp_only", "sub_spillover")}
    assert table["sub_only", "comp_spillover"].ATE == 0 and table["sub_only", "comp_spillover"].se == pytest.approx(0, abs=1e-12)
    alone = dml.run_graph_dml(panel, edges.filter("graph = 'sub'"), with_cate=False, **options).effects.collect()
    for r in alone:
        assert table["sub_only", r.effect].ATE == pytest.approx(r.ATE, abs=1e-10)
        assert table["sub_only", r.effect].se == pytest.approx(r.se, abs=1e-10)
    binary = dml.run_graph_dml(panel, edges, weight_type="binary", with_cate=False, **options).effects.collect()
    for r in binary:
        assert table["binary_weights", r.effect].ATE == pytest.approx(r.ATE, abs=1e-10)


def test_baselines_stack_into_one_table(study):
    panel, edges = study
    from ripplecart.operators.exposure import add_spillover_features

    rows = baselines.run_all_baselines(
        add_spillover_features(panel, edges), nuisance=Nuisance("cell_mean"), n_folds=2, forest_trees=8, forest_depth=3,
    ).collect()
    assert [r.model for r in rows] == ["ols_no_graph", "causal_forest_no_graph", "dml_no_graph", "dml_unweighted_spillover"]
    assert [r.n_obs for r in rows] == [4 * 24 * 12] * 4
    assert all(r.CI_lower < r.ATE < r.CI_upper for r in rows)
    tidy = interpret.compare_models(baselines.ols_baseline(panel), dml.effects_table(panel.sparkSession, "g", ["direct"], linear.LinearFit(np.ones(1), np.ones(1), np.eye(1), 3), 0.95))
    assert {r.source for r in tidy.collect()} == {"baseline", "graph"}


def test_mean_effect_of_a_linear_cate_matches_numpy(spark):
    rng = np.random.default_rng(8)
    n = 800
    w = np.column_stack([rng.normal(5, 2, n), rng.integers(0, 3, n)])
    t = rng.normal(size=n)
    y = (0.5 + 0.1 * w[:, 0]) * t + rng.normal(size=n)
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(w, t, y)], "w array<double>, t double, y double")
    fit = dml.fit_linear_cate(df, "y", ["t"], inference=True)
    z = np.column_stack([np.ones(n), (w - w.mean(0)) / w.std(0, ddof=1)]) * t[:, None]
    inv = np.linalg.inv(z.T @ z)
    theta = inv @ z.T @ y
    cov = inv @ (z.T * (y - z @ theta) ** 2) @ z @ inv * n / (n - 3)
    mean = fit.mean_effects()
    assert mean.beta[0] == pytest.approx(theta[0]) and mean.se[0] == pytest.approx(np.sqrt(cov[0, 0]))
    got = [r[0] for r in df.select(fit.column(0)).collect()]
    assert np.mean(got) == pytest.approx(theta[0])


def test_forest_recovers_a_known_effect_and_its_bands_cover(spark):
    rng = np.random.default_rng(12)
    n = 6000
    w = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 5, n), rng.normal(size=n)]).astype(float)
    tau = np.where(w[:, 0] < 10, 1.0, 3.0)
    t = rng.normal(size=n)
    y = tau * t + rng.normal(size=n)
    df = settled(spark.createDataFrame([(i, a.tolist(), float(b), float(c)) for i, (a, b, c) in enumerate(zip(w, t, y))], "id bigint, w array<double>, t_res double, y_res double").repartition(4))
    settings = forest.ForestSettings(trees=100, depth=5, sample=0.3)
    got = forest.causal_forest(df.select(F.col("id").alias("row"), "w", "t_res", "y_res"), ["row"], settings).orderBy("row").toPandas()
    assert len(got) == n and got.cate.notna().all() and (got.cate_se > 0).all()
    assert abs(got.cate.mean() - tau.mean()) < 0.1 and np.corrcoef(got.cate, tau)[0, 1] > 0.95
    covered = np.abs(got.cate.to_numpy() - tau) <= 1.96 * got.cate_se
    assert covered[(w[:, 0] < 8) | (w[:, 0] > 11)].mean() > 0.85  # away from the jump the trees can tell the sides apart
    flat = np.where(w[:, 0] < 10, 0, 1)
    assert got.cate[flat == 1].mean() - got.cate[flat == 0].mean() == pytest.approx(2.0, abs=0.25)


def test_forest_grows_the_same_trees_by_levels_and_in_tasks(spark):
    rng = np.random.default_rng(13)
    n = 2000
    w = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 30, n)]).astype(np.uint8)
    t = rng.normal(size=n)
    y = (1 + (w[:, 0] > 4)) * t + 0.3 * rng.normal(size=n)
    df = settled(spark.createDataFrame([(int(i) * 7919, bytes(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(w, t, y))], "id bigint, bins binary, t double, y double").repartition(3))
    grown = [forest.grow_forest(df, 2, forest.ForestSettings(trees=8, depth=4, sample=0.4, node_rows=rows)) for rows in (10**9, 100)]
    assert (grown[0].split == grown[1].split).all() and grown[0].split.sum() > 20
    for name in ("feature", "cut"):
        assert (getattr(grown[0], name)[grown[0].split] == getattr(grown[1], name)[grown[0].split]).all()
    assert (grown[0].feature[:, 0] == 0).mean() > 0.8  # the column that the effect depends on
    leaves = forest._node_moments(df, grown[0], 2, True)
    rows = [forest.members(np.array([7919 * i for i in range(n)], np.uint64), tree, grown[0].settings) for tree in range(8)]
    for tree, (member, held) in enumerate(rows):
        node = grown[0].node_of(tree, w[member[held]])
        assert leaves[0, tree].sum() == held.sum() and (leaves[0, tree][np.unique(node)] >= 5).all()
        assert leaves[4, tree, node[0]] == pytest.approx((t * y)[member[held]][node == node[0]].sum())
    a, b = forest.members(np.arange(10_000, dtype=np.uint64), 0, forest.ForestSettings())[0], forest.members(np.arange(10_000, dtype=np.uint64), 1, forest.ForestSettings())[0]
    assert 850 < len(a) < 1150 and 120 < len(np.intersect1d(a, b)) < 290  # a bag shares its half: a fifth of a tree's rows


def test_balance_is_zero_for_a_constant_and_skips_text(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, "x"), (1, 4.0, 5.0, "x"), (0, 1.0, 5.0, "y"), (0, 3.0, 5.0, "y")], "promo_any int, a double, k double, s string")
    got = {r.covariate: r for r in evaluate.covariate_balance(df, covariates=["a", "k", "s", "absent"]).collect()}
    assert set(got) == {"a", "k"} and got["k"].smd == 0 and got["k"].acceptable
    assert got["a"].smd == pytest.approx(1 / np.sqrt(2)) and not got["a"].acceptable


def test_coverage_counts_both_ends(spark):
    sims = spark.createDataFrame(
        [(1, "direct", 0.1, 0.1, 0.1, 0.2), (2, "direct", 0.1, 0.3, 0.0, 0.1), (3, "direct", 0.1, 0.5, 0.2, 0.9)],
        "sim_id int, effect string, true_value double, estimate double, ci_lower double, ci_upper double",
    )
    r = evaluate.synthetic_evaluation(sims).first()
    assert r.coverage == pytest.approx(2 / 3) and r.n_sims == 3 and r.mean_bias == pytest.approx(0.2)
    assert r.rmse == pytest.approx(np.sqrt((0.04 + 0.16) / 3)) and r.std_bias == pytest.approx(0.2)


def test_top_products_by_magnitude_with_ties_by_id(spark):
    df = spark.createDataFrame([(3, -0.5), (1, 0.5), (2, 0.1), (4, None)], "PRODUCT_ID bigint, sub_spillover_cate double")
    assert [r.PRODUCT_ID for r in interpret.top_spillover_products(df, "sub_spillover", 2).collect()] == [1, 3]
    with pytest.raises(ValueError):
        interpret.top_spillover_products(df, "other")


def test_boosted_query_fits_the_study_size(monkeypatch):
    from types import SimpleNamespace

    from ripplecart.plans import queries

    asked = {}
    monkeypatch.setattr(queries.dml, "run_graph_dml", lambda *_, **options: asked.update(options) or SimpleNamespace(effects=None))
    queries.dml_graph_gbt(SimpleNamespace(panel=None, edges=None))
    model = asked["nuisance"]
    assert (model.kind, model.trees, model.depth, model.step, asked["n_folds"]) == ("gbt", 200, 6, 0.1, 5)
