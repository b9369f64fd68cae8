"""The named queries: each a Spark job over the tables of a folder, most with an SQL oracle.

A query's column list fixes names and types on both sides: ``b`` bigint, ``i`` int, a digit for a
double rounded to that many decimals, nothing for strings and booleans.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecart.config import CELL, EFFECTS, HIERARCHY, PRODUCT, STORE, WEEK, StudyConfig
from ripplecart.functions.distributed import _scratch, histogram, percentiles, permute_column, sample_exact, settled
from ripplecart.operators import baselines, complements, covariates, dml, embeddings, evaluate, exposure, graphs
from ripplecart.operators import interpret, panel as panels, profile, substitutes, walks
from ripplecart.operators.linear import clustered_ols, ols_hc1
from ripplecart.operators.nuisance import Nuisance, residualise
from ripplecart.plans import oracle as sql
from ripplecart.plans.workbench import Workbench
from ripplecart.sources import csv_tables, stores

CELL_COLS = "STORE_ID:b PRODUCT_ID:b WEEK_NO:i"
PANEL_COLS = (
    f"{CELL_COLS} units_sold:6 sales_value:4 retail_disc_total:4 discount_rate:6 sold_any:i display:i mailer:i "
    "promo_any:i DEPARTMENT COMMODITY_DESC SUB_COMMODITY_DESC BRAND"
)
EXPOSURES = "sub_exposure_weighted:6 sub_exposure_sum:6 comp_exposure_weighted:6 comp_exposure_sum:6"
FEATURES = (
    "n_treated_substitutes:b frac_treated_substitutes:6 avg_units_substitutes:6 "
    "n_treated_complements:b frac_treated_complements:6 avg_units_complements:6"
)
EFFECT_COLS = "model effect ATE:6 se:6 CI_lower:6 CI_upper:6 n_obs:b"
SPLITS = {"train_weeks": (1, 60), "val_weeks": (61, 75), "test_weeks": (76, 88)}
CELL_MEAN = Nuisance("cell_mean")
LINEAR = Nuisance("linear")
GBT = Nuisance("gbt")
EDGE, BINARY = "graph_dml_edge_weight", "graph_dml_binary"


@dataclass(frozen=True)
class Query:
    run: Callable[[Workbench], DataFrame]
    columns: tuple[tuple[str, str], ...]
    oracle: str | None
    catalog: str = "folded"

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.run(Workbench(spark, folder, catalog=self.catalog))
        out = []
        for name, kind in self.columns:
            c = F.col(name)
            if kind == "b":
                c = c.cast("bigint")
            elif kind == "i":
                c = c.cast("int")
            elif kind:
                c = F.round(c.cast("double"), int(kind))
            out.append(c.alias(name))
        return df.select(*out)

    def sql(self) -> str | None:
        if self.oracle is None:
            return None
        out = []
        for name, kind in self.columns:
            if kind == "b":
                out.append(f"CAST({name} AS BIGINT) AS {name}")
            elif kind == "i":
                out.append(f"CAST({name} AS INTEGER) AS {name}")
            elif kind:
                out.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}")
            else:
                out.append(f'"{name}"')
        return sql.with_ctes(f"SELECT {', '.join(out)} FROM ({self.oracle}) q", sql.CATALOG if self.catalog == "part" else None)


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, oracle: str | None = None, catalog: str = "folded"):
    spec = tuple((c.partition(":")[0], c.partition(":")[2]) for c in columns.split())

    def register(run: Callable[[Workbench], DataFrame]):
        QUERIES[name] = Query(run, spec, oracle, catalog)
        return run

    return register


def scratch(b: Workbench, name: str) -> str:
    """A fresh folder next to the settled tables."""
    return f"{_scratch(b.spark)}/{name}-{uuid.uuid4().hex}"


# ── sources and sinks ─────────────────────────────────────────────────────────


def _csv_folder(b: Workbench) -> str:
    """The retail views as the eight raw CSV files, headers padded to exercise the stripping."""
    folder = scratch(b, "raw")
    tables = b.views.tables()
    for name, file in csv_tables.RAW_FILES.items():
        df = tables[name]
        df.select(*[F.col(c).alias(f" {c} ") for c in df.columns]).write.mode("overwrite").csv(
            f"{folder}/{file}", header=True, nullValue="nan", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    return folder


@query(
    "raw_table_sizes", "table_name n_rows:b n_cols:i",
    """SELECT 'transactions' AS table_name, count(*) AS n_rows, 11 AS n_cols FROM tx UNION ALL
       SELECT 'causal', count(*), 5 FROM causal UNION ALL SELECT 'products', count(*), 5 FROM product UNION ALL
       SELECT 'campaign_hh', count(*), 2 FROM campaign_table UNION ALL SELECT 'redemptions', count(*), 3 FROM redemptions
       UNION ALL SELECT 'demographics', count(*), 2 FROM demographics UNION ALL
       SELECT 'campaigns', count(DISTINCT CAMPAIGN), 3 FROM campaign_table UNION ALL
       SELECT 'coupons', count(DISTINCT COUPON_UPC), 1 FROM redemptions""",
)
def raw_table_sizes(b):
    return csv_tables.table_sizes(csv_tables.read_raw_tables(b.spark, _csv_folder(b)))


@query("panel_from_csv", PANEL_COLS, "SELECT * FROM panel")
def panel_from_csv(b):
    folder = _csv_folder(b)
    paths = [f"{folder}/{csv_tables.RAW_FILES[t]}" for t in ("transactions", "causal", "products")]
    return panels.build_panel_from_csv(b.spark, *paths)


@query("panel_store", f"{CELL_COLS} units_sold:6 promo_any:i", "SELECT * FROM panel WHERE WEEK_NO BETWEEN 61 AND 75")
def panel_store(b):
    path = scratch(b, "panel-store")
    stores.write_panel(b.panel, path)
    return panels.temporal_split(stores.read_panel(b.spark, path), **SPLITS)["val"]


@query("graph_store", "graph src:b dst:b w:6", "SELECT * FROM edges")
def graph_store(b):
    path = scratch(b, "graph-store")
    stores.write_graphs(b.edges, path)
    return stores.read_graphs(b.spark, path)


@query(
    "embedding_store", "PRODUCT_ID:b dim:i norm2:5",
    """SELECT PRODUCT_ID, coalesce(len(v), 0) AS dim, coalesce(list_dot_product(v, v), 0) AS norm2
       FROM nodes LEFT JOIN emb USING (PRODUCT_ID)""",
)
def embedding_store(b):
    path = scratch(b, "embedding-store")
    stores.write_embeddings(b.nodes.join(b.views.embeddings(), PRODUCT, "left"), path)
    e = F.col("embedding")
    norm2 = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return stores.read_embeddings(b.spark, path).select(
        PRODUCT, F.coalesce(F.size(F.coalesce(e, F.array())), F.lit(0)).alias("dim"), F.coalesce(norm2, F.lit(0.0)).alias("norm2")
    )


# ── panel ─────────────────────────────────────────────────────────────────────


@query("tx_cells", f"{CELL_COLS} units_sold:6 sales_value:4 retail_disc_total:4 discount_rate:6", "SELECT * FROM cells")
def tx_cells(b):
    return b.views.cells()


@query("product_week_range", "PRODUCT_ID:b week_min:i week_max:i", "SELECT * FROM week_range")
def product_week_range(b):
    return panels.product_week_range(b.views.cells())


@query("product_stores", "PRODUCT_ID:b STORE_ID:b", "SELECT * FROM pstores")
def product_stores(b):
    return panels.product_stores(b.views.cells())


@query("dense_index", CELL_COLS, "SELECT * FROM idx")
def dense_index(b):
    return panels.dense_index(b.views.cells())


@query("panel_full", PANEL_COLS, "SELECT * FROM panel")
def panel_full(b):
    return b.views.panel()


@query("panel_flags", f"{CELL_COLS} display:i mailer:i promo_any:i", "SELECT * FROM flags")
def panel_flags(b):
    return panels.promo_flags(b.views.causal())


@query(
    "panel_summary", "n_rows:b n_zero:b zero_share:6 n_treated:b treated_share:6",
    """SELECT count(*) AS n_rows, count(*) FILTER (units_sold = 0) AS n_zero,
       avg(CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END) AS zero_share, sum(promo_any) AS n_treated,
       avg(promo_any) AS treated_share FROM panel""",
)
def panel_summary(b):
    return profile.panel_summary(b.panel)


@query("weekly_treatment_rate", "WEEK_NO:i treatment_rate:6", "SELECT WEEK_NO, avg(promo_any) AS treatment_rate FROM panel GROUP BY 1")
def weekly_treatment_rate(b):
    return profile.weekly_treatment_rate(b.panel)


@query(
    "temporal_split_summary", "split n_rows:b week_min:i week_max:i",
    """SELECT split, count(*) AS n_rows, min(WEEK_NO) AS week_min, max(WEEK_NO) AS week_max FROM (
       SELECT WEEK_NO, CASE WHEN WEEK_NO BETWEEN 1 AND 60 THEN 'train' WHEN WEEK_NO BETWEEN 61 AND 75 THEN 'val'
       WHEN WEEK_NO BETWEEN 76 AND 88 THEN 'test' END AS split FROM panel) WHERE split IS NOT NULL GROUP BY 1""",
)
def temporal_split_summary(b):
    return profile.split_summary(panels.with_split(b.panel, **SPLITS))


@query(
    "demand_filter", f"{CELL_COLS} units_sold:6",
    "SELECT * FROM panel WHERE PRODUCT_ID IN (SELECT PRODUCT_ID FROM panel GROUP BY 1 HAVING avg(units_sold) >= 25)",
)
def demand_filter(b):
    return panels.demand_filter(b.panel, 25.0)


@query(
    "sample_diagnostics", "metric value:6",
    """SELECT 'rows_before_filter' AS metric, count(*) AS value FROM panel UNION ALL
       SELECT * FROM (WITH k AS (SELECT * FROM panel WHERE PRODUCT_ID IN
         (SELECT PRODUCT_ID FROM panel GROUP BY 1 HAVING avg(units_sold) >= 25))
       SELECT 'rows_after_filter', count(*) FROM k UNION ALL
       SELECT 'zero_share_after_filter', avg(CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END) FROM k UNION ALL
       SELECT 'promo_share_after_filter', avg(promo_any) FROM k)""",
)
def sample_diagnostics(b):
    return profile.sample_diagnostics(b.panel, panels.demand_filter(b.panel, 25.0))


@query(
    "treated_vs_control", "arm mean_outcome:6 mean_log_outcome:6",
    """SELECT CASE WHEN promo_any = 1 THEN 'treated' ELSE 'control' END AS arm, avg(units_sold) AS mean_outcome,
       avg(ln(1 + units_sold)) AS mean_log_outcome FROM panel GROUP BY 1""",
)
def treated_vs_control(b):
    return profile.treated_vs_control(b.panel)


@query(
    "sample_exact_n", CELL_COLS,
    f"""SELECT STORE_ID, PRODUCT_ID, WEEK_NO FROM panel
        ORDER BY {sql.u("42", "'sample'", *sql.CELL_PARTS)}, STORE_ID, PRODUCT_ID, WEEK_NO LIMIT 5000""",
)
def sample_exact_n(b):
    return sample_exact(b.panel, CELL, 5000, seed=42)


# ── graphs ────────────────────────────────────────────────────────────────────


@query("product_baskets", "PRODUCT_ID:b n_baskets:b", "SELECT * FROM marginal")
def product_baskets(b):
    return complements.product_baskets(complements.basket_items(b.views.transactions()))


@query("cooccurrence_pairs", "a:b b:b n_ab:b", "SELECT * FROM pairs")
def cooccurrence_pairs(b):
    return complements.cooccurrence(complements.basket_items(b.views.transactions()), 10)


@query("cooccurrence_pairs_wide", "a:b b:b n_ab:b", "SELECT * FROM pairs")
def cooccurrence_pairs_wide(b):
    """The same counts with baskets of more than five products taken as too wide to enumerate."""
    return complements.cooccurrence(complements.basket_items(b.views.transactions()), 10, wide_basket=5)


@query("complement_edges", "src:b dst:b w:6", "SELECT * FROM comp_edges")
def complement_edges(b):
    return complements.complement_edges(b.views.transactions())


@query(
    "complement_edges_universe", "src:b dst:b w:6",
    """SELECT * FROM (
       WITH it AS (SELECT DISTINCT BASKET_ID, PRODUCT_ID FROM tx WHERE PRODUCT_ID IN (SELECT PRODUCT_ID FROM product WHERE BRAND = 'National')),
       mg AS (SELECT PRODUCT_ID, count(*) AS n FROM it GROUP BY 1),
       pr AS (SELECT x.PRODUCT_ID AS a, y.PRODUCT_ID AS b, count(*) AS n FROM it x JOIN it y
              ON x.BASKET_ID = y.BASKET_ID AND x.PRODUCT_ID < y.PRODUCT_ID GROUP BY 1, 2 HAVING count(*) >= 8),
       sc AS (SELECT a, b, ln(CAST(pr.n AS DOUBLE) * (SELECT count(DISTINCT BASKET_ID) FROM it) / (ma.n * mb.n)) AS p
              FROM pr JOIN mg ma ON a = ma.PRODUCT_ID JOIN mg mb ON b = mb.PRODUCT_ID),
       nw AS (SELECT a, b, p / (SELECT max(p) FROM sc) AS w FROM sc WHERE p > 0)
       SELECT a AS src, b AS dst, w FROM nw UNION ALL SELECT b, a, w FROM nw)""",
)
def complement_edges_universe(b):
    universe = b.views.products().filter(F.col("BRAND") == "National")
    return complements.complement_edges(b.views.transactions(), 8, universe)


@query("substitute_edges", "src:b dst:b w:6", "SELECT * FROM sub_edges")
def substitute_edges(b):
    return substitutes.substitute_edges(b.views.products(), b.views.embeddings())


@query("substitute_edges_top3", "src:b dst:b w:6", "SELECT * FROM sub_edges_3")
def substitute_edges_top3(b):
    return substitutes.substitute_edges(b.views.products(), b.views.embeddings(), max_neighbors=3, block=2)


@query("substitute_edges_binary", "src:b dst:b w:6", "SELECT * FROM sub_plain_2")
def substitute_edges_binary(b):
    return substitutes.substitute_edges(b.views.products(), max_neighbors=2)


@query(
    "graph_summary", "graph n_nodes:b n_edges:b density:6 w_min:6 w_max:6",
    """SELECT graph, n AS n_nodes, count(*) // 2 AS n_edges, CAST(count(*) AS DOUBLE) / (n * (n - 1)) AS density,
       min(w) AS w_min, max(w) AS w_max FROM edges, (SELECT count(*) AS n FROM nodes) c GROUP BY graph, n""",
)
def graph_summary(b):
    return graphs.graph_summary(b.edges, b.nodes)


DEGREES = """SELECT g.graph, nodes.PRODUCT_ID, count(e.src) AS degree FROM nodes
  CROSS JOIN (SELECT 'sub' AS graph UNION ALL SELECT 'comp') g
  LEFT JOIN edges e ON e.graph = g.graph AND e.src = nodes.PRODUCT_ID GROUP BY 1, 2"""


@query("degree_distribution", "graph degree:b n_nodes:b", f"SELECT graph, degree, count(*) AS n_nodes FROM ({DEGREES}) GROUP BY 1, 2")
def degree_distribution(b):
    return graphs.degree_distribution(b.edges, b.nodes)


@query("median_degree", "graph median_degree:6", f"SELECT graph, quantile_cont(degree, 0.5) AS median_degree FROM ({DEGREES}) GROUP BY 1")
def median_degree(b):
    return graphs.median_degree(b.edges, b.nodes)


def _hist_sql(value: str, source: str, bins: int) -> str:
    return f"""SELECT least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS INTEGER), {bins - 1}) AS bin,
        lo + least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS INTEGER), {bins - 1}) * ((hi - lo) / {bins}) AS bin_start,
        count(*) AS n FROM (SELECT CAST({value} AS DOUBLE) AS v, min({value}) OVER () AS lo, max({value}) OVER () AS hi
        FROM {source}) GROUP BY 1, 2"""


@query("weight_histogram", "bin:i bin_start:6 n:b", _hist_sql("w", "comp_edges", 60))
def weight_histogram(b):
    return graphs.weight_histogram(b.edges, "comp", 60)


@query(
    "edge_labels_sample", "src:b dst:b w:6 src_label dst_label",
    f"""SELECT src, dst, w, x.SUB_COMMODITY_DESC AS src_label, y.SUB_COMMODITY_DESC AS dst_label FROM (
        SELECT src, dst, w FROM sub_edges WHERE src < dst ORDER BY {sql.u("42", "'edge'", "src", "dst")}, src, dst LIMIT 10) s
        JOIN product x ON x.PRODUCT_ID = src JOIN product y ON y.PRODUCT_ID = dst""",
)
def edge_labels_sample(b):
    return graphs.edge_label_sample(b.edges, b.views.products(), "sub", 10)


@query(
    "embedding_coverage", "n_nodes:b n_nonzero:b share_nonzero:6",
    """SELECT count(*) AS n_nodes, count(v) AS n_nonzero, avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END) AS share_nonzero
       FROM nodes LEFT JOIN emb USING (PRODUCT_ID)""",
)
def embedding_coverage(b):
    return graphs.embedding_coverage(b.views.embeddings(), b.nodes)


@query("transition_table", "src:b dst:b prob:6 cum:6", "SELECT * FROM transitions")
def transition_table(b):
    return walks.transition_table(b.complements)


STARTS = """SELECT r + k * 2 AS walk_id, PRODUCT_ID AS n0 FROM (SELECT unnest([0, 1]) AS r),
    (SELECT PRODUCT_ID, row_number() OVER (ORDER BY PRODUCT_ID) - 1 AS k FROM nodes)"""


def _unbiased_step(prev: str, at: int) -> str:
    draw = sql.u("42", "'walk'", "walk_id", str(at))
    return f"""SELECT s.*, t.nxt AS n{at} FROM ({prev}) s LEFT JOIN LATERAL (
        SELECT coalesce(min(dst) FILTER (cum > {draw}), max(dst)) AS nxt FROM transitions WHERE src = s.n{at - 1}) t ON true"""


def _as_walk(*nodes: str) -> str:
    return f"concat_ws(',', {', '.join(f'CAST({n} AS VARCHAR)' for n in nodes)}) AS walk"


@query(
    "walks_unbiased_3", "walk_id:b walk",
    f"SELECT walk_id, {_as_walk('n0', 'n1', 'n2', 'n3')} FROM ({_unbiased_step(_unbiased_step(_unbiased_step(STARTS, 1), 2), 3)})",
)
def walks_unbiased_3(b):
    out = walks.unbiased_walks(b.complements, b.nodes, num_walks=2, walk_length=4)
    return out.select("walk_id", F.array_join("walk", ",").alias("walk"))


def _biased_walk_sql(num_walks: int, length: int, p: float, q: float) -> str:
    """Biased walks by recursion, one proposal of every walker per round."""
    draw, accept = (sql.u("42", f"'{name}'", "walk_id", "step + 1", "trial") for name in ("bwalk", "baccept"))
    factor = f"CASE WHEN prev IS NULL THEN {max(1, 1 / p, 1 / q)} WHEN cand = prev THEN {1 / p} WHEN k.dst IS NOT NULL THEN 1.0 ELSE {1 / q} END"
    starts = STARTS.replace("[0, 1]", f"range({num_walks})").replace("k * 2", f"k * {num_walks}")
    return f"""SELECT walk_id, string_agg(CAST(node AS VARCHAR), ',' ORDER BY step) AS walk, count(*) AS n_nodes FROM (
        WITH RECURSIVE w AS (
          SELECT walk_id, CAST(NULL AS BIGINT) AS prev, n0 AS node, 0 AS step, 0 AS trial FROM ({starts}) UNION ALL
          SELECT walk_id, CASE WHEN taken THEN node ELSE prev END, CASE WHEN taken THEN cand ELSE node END,
                 CASE WHEN taken THEN step + 1 ELSE step END, CASE WHEN taken THEN 0 ELSE trial + 1 END
          FROM (SELECT c.*, {accept} * {max(1, 1 / p, 1 / q)} < {factor} AS taken FROM (
              SELECT walk_id, prev, node, step, trial, coalesce(min(dst) FILTER (cum > {draw}), max(dst)) AS cand
              FROM w JOIN transitions ON src = node WHERE step < {length - 1} GROUP BY walk_id, prev, node, step, trial) c
            LEFT JOIN comp_edges k ON k.src = prev AND k.dst = cand))
        SELECT * FROM w WHERE trial = 0) GROUP BY 1"""


@query("walks_biased_2", "walk_id:b walk", _biased_walk_sql(2, 3, 0.5, 2.0))
def walks_biased_2(b):
    out = walks.biased_walks(b.complements, b.nodes, num_walks=2, walk_length=3, p=0.5, q=2.0)
    return out.select("walk_id", F.array_join("walk", ",").alias("walk"))


def _long_walk_sql(num_walks: int, length: int) -> str:
    """Unbiased walks by recursion, one step per round."""
    draw = sql.u("42", "'walk'", "w.walk_id", "w.step + 1")
    starts = STARTS.replace("[0, 1]", f"range({num_walks})").replace("k * 2", f"k * {num_walks}")
    return f"""SELECT walk_id, string_agg(CAST(node AS VARCHAR), ',' ORDER BY step) AS walk, count(*) AS n_nodes FROM (
        WITH RECURSIVE w AS (
          SELECT walk_id, n0 AS node, 0 AS step FROM ({starts}) UNION ALL
          SELECT w.walk_id, coalesce(min(dst) FILTER (cum > {draw}), max(dst)), w.step + 1
          FROM w JOIN transitions ON src = w.node WHERE w.step < {length - 1} GROUP BY w.walk_id, w.step)
        SELECT * FROM w) GROUP BY 1"""


@query("walks_full", "walk_id:b walk n_nodes:i", _long_walk_sql(10, 80))
def walks_full(b):
    out = walks.unbiased_walks(b.complements, b.nodes, num_walks=10, walk_length=80)
    return out.select("walk_id", F.array_join("walk", ",").alias("walk"), F.size("walk").alias("n_nodes"))


@query("walks_biased_full", "walk_id:b walk n_nodes:i", _biased_walk_sql(10, 80, 0.5, 2.0))
def walks_biased_full(b):
    """The reference's size: 10 walks of 80 nodes from every product."""
    out = walks.biased_walks(b.complements, b.nodes, num_walks=10, walk_length=80, p=0.5, q=2.0)
    return out.select("walk_id", F.array_join("walk", ",").alias("walk"), F.size("walk").alias("n_nodes"))


@query("node_embeddings", "PRODUCT_ID:b dim:i norm:6")
def node_embeddings(b):
    out = b.trained
    e = F.col("embedding")
    return out.select(
        PRODUCT, F.size(e).alias("dim"), F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm")
    )


@query("node_embedding_neighbours", "n_nodes:b dim:i near_in_graph", "SELECT count(*) AS n_nodes, 64 AS dim, true AS near_in_graph FROM nodes")
def node_embedding_neighbours(b):
    """Whether 95 of 100 nearest vectors belong to products at most two steps away; nodes without edges have no say."""
    near = substitutes.nearest_by_vector(b.trained, 1).select("src", F.col("dst").alias("near"))
    step = b.complements.select("src", "dst")
    two = step.unionByName(step.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))).distinct()
    met = two.withColumnRenamed("dst", "near").withColumn("met", F.lit(True))
    linked = step.select("src").distinct().withColumn("linked", F.lit(True))
    out = b.trained.select(F.col(PRODUCT).alias("src"), F.size("embedding").alias("dim")).join(near, "src", "left").join(met, ["src", "near"], "left").join(linked, "src", "left")
    holds = F.avg((F.col("linked").isNull() | F.coalesce("met", F.lit(False))).cast("double")) >= 0.95
    return out.agg(F.count(F.lit(1)).alias("n_nodes"), F.min("dim").alias("dim"), holds.alias("near_in_graph"))


def _pca_sql() -> str:
    """Leading eigenvectors of the covariance by repeated squaring, the second after the first is taken out."""
    squared = "list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / (t * t)))"
    trace = "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))"
    grown = lambda name, source: f"""{name}_p(k, m) AS (  -- m to the power 2 ** 14, scaled
          SELECT 0, m FROM {source} UNION ALL SELECT k + 1, {squared} FROM (SELECT k, m, {trace} AS t FROM {name}_p) WHERE k < 14
        ), {name}_v AS (
          SELECT list_transform(r, lambda a: a / sqrt(list_dot_product(r, r)) * CASE WHEN r[list_position(list_transform(r, lambda b: abs(b)), list_max(list_transform(r, lambda b: abs(b))))] < 0 THEN -1 ELSE 1 END) AS v
          FROM (SELECT m[list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]), list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i])))] AS r FROM {name}_p WHERE k = 14)
        )"""  # noqa: E731
    return f"""SELECT * FROM (
        WITH RECURSIVE x AS (
          SELECT PRODUCT_ID, list_transform(v, lambda a: a / sqrt(list_dot_product(v, v))) AS u FROM emb WHERE list_dot_product(v, v) > 0
        ), cov AS (
          SELECT i, j, covar_samp(u[i], u[j]) AS c FROM x, (SELECT unnest(range(1, (SELECT max(len(u)) FROM x) + 1)) AS i), (SELECT unnest(range(1, (SELECT max(len(u)) FROM x) + 1)) AS j) GROUP BY i, j
        ), c1 AS (
          SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)
        ), {grown("one", "c1")}, top AS (
          SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l, m, {trace} AS total FROM one_v, c1
        ), c2 AS (
          SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM top
        ), {grown("two", "c2")}, second AS (
          SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM two_v, c2
        ), named AS (
          SELECT x.*, coalesce(DEPARTMENT, 'UNKNOWN') AS d FROM x LEFT JOIN product USING (PRODUCT_ID)
        ), frequent AS (
          SELECT d AS label FROM named GROUP BY d ORDER BY count(*) DESC, d LIMIT 10
        )
        SELECT PRODUCT_ID, label, list_dot_product(u, top.v) AS pc1, list_dot_product(u, second.v) AS pc2, top.l / total AS explained_1, second.l / total AS explained_2
        FROM named LEFT JOIN frequent ON d = label CROSS JOIN top CROSS JOIN second)"""


@query("embedding_pca", "PRODUCT_ID:b label pc1:6 pc2:6 explained_1:6 explained_2:6", _pca_sql())
def embedding_pca(b):
    return embeddings.pca_projection(b.views.embeddings(), b.views.products(), 10)


# ── exposure ──────────────────────────────────────────────────────────────────


@query("exposure_weighted", f"{CELL_COLS} {EXPOSURES}", "SELECT * FROM exposed")
def exposure_weighted(b):
    return exposure.add_exposures(b.panel, b.edges)


@query("exposure_blocks", f"{CELL_COLS} {EXPOSURES}", "SELECT * FROM exposed")
def exposure_blocks(b):
    """The way of edge lists beyond one broadcast: blocks of about 2,000 edges meet the rows in a shuffled grid."""
    return exposure.add_exposures(b.panel, b.edges, block_rows=2000)


@query("exposure_interval", f"{CELL_COLS} {EXPOSURES}", "SELECT * FROM exposed")
def exposure_interval(b):
    return exposure.add_exposures(b.panel, b.edges, denominator="interval")


@query("exposure_binary", f"{CELL_COLS} {EXPOSURES}", sql.exposures(weight="1.0"))
def exposure_binary(b):
    return exposure.add_exposures(b.panel, b.edges, weight_type="binary")


@query("exposure_discount", f"{CELL_COLS} {EXPOSURES}", "SELECT * FROM exposed_discount")
def exposure_discount(b):
    return exposure.add_exposures(b.panel, b.edges, treatment="discount_rate")


@query(
    "exposure_sub_only", f"{CELL_COLS} {EXPOSURES}",
    f"SELECT {sql.KEYS}, sub_exposure_weighted, sub_exposure_sum, 0.0 AS comp_exposure_weighted, 0.0 AS comp_exposure_sum FROM exposed",
)
def exposure_sub_only(b):
    return exposure.add_exposures(b.panel, exposure.without_channel(b.edges, "comp"))


@query(
    "exposure_filtered", f"{CELL_COLS} {EXPOSURES}",
    sql.exposures(panel="(SELECT * FROM panel WHERE PRODUCT_ID IN (SELECT PRODUCT_ID FROM panel GROUP BY 1 HAVING avg(units_sold) >= 25)) AS pf")
    .replace(") AS pf p LEFT", ") p LEFT"),
)
def exposure_filtered(b):
    """Products below the demand threshold are gone before the exposure and count as absent."""
    return exposure.add_exposures(panels.demand_filter(b.panel, 25.0), b.edges)


@query(
    "exposure_one_graph", f"{CELL_COLS} exposure_weighted:6 exposure_sum:6",
    "SELECT *, comp_exposure_weighted AS exposure_weighted, comp_exposure_sum AS exposure_sum FROM exposed",
)
def exposure_one_graph(b):
    return exposure.weighted_exposure(b.panel, b.complements)


@query("spillover_features", f"{CELL_COLS} {FEATURES}", "SELECT * FROM featured")
def spillover_features(b):
    return exposure.add_spillover_features(b.panel, b.edges)


@query(
    "treated_neighbor_rows", "n_sub:b n_comp:b",
    """SELECT count(*) FILTER (n_treated_substitutes > 0) AS n_sub, count(*) FILTER (n_treated_complements > 0) AS n_comp
       FROM featured""",
)
def treated_neighbor_rows(b):
    return profile.treated_neighbour_rows(b.featured)


SHARES = ("frac_treated_substitutes", "frac_treated_complements")


@query(
    "feature_histogram", "feature bin:i bin_start:6 n:b",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, * FROM ({_hist_sql(c, f'featured WHERE {c} > 0', 40)})" for c in SHARES),
)
def feature_histogram(b):
    parts = [histogram(b.featured.filter(F.col(c) > 0), F.col(c), 40).withColumn("feature", F.lit(c)) for c in SHARES]
    return parts[0].unionByName(parts[1])


@query(
    "exposure_by_department", "DEPARTMENT promo_any:i mean_exposure:6 n_rows:b",
    f"""SELECT DEPARTMENT, promo_any, avg(sub_exposure_weighted) AS mean_exposure, count(*) AS n_rows FROM (
        {sql.exposures(edges="(SELECT 'sub' AS graph, src, dst, 1.0 AS w FROM sub_scored) e")}) GROUP BY 1, 2""",
)
def exposure_by_department(b):
    """Flagship: tables to panel to substitute graph to exposure, averaged by department and arm."""
    edges = settled(substitutes.substitute_edges(b.views.products()), "edges")
    exposed = exposure.add_exposures(b.panel, edges)
    return exposed.groupBy("DEPARTMENT", "promo_any").agg(
        F.avg("sub_exposure_weighted").alias("mean_exposure"), F.count(F.lit(1)).alias("n_rows")
    )


# ── covariates, folds, estimation ─────────────────────────────────────────────


@query(
    "label_codes", "PRODUCT_ID:b DEPARTMENT_code:i COMMODITY_DESC_code:i SUB_COMMODITY_DESC_code:i BRAND_code:i",
    "SELECT PRODUCT_ID, " + ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_code" for c in HIERARCHY) + " FROM product",
)
def label_codes(b):
    return covariates.with_label_codes(b.views.products())


@query(
    "covariate_vectors", "PRODUCT_ID:b WEEK_NO:i STORE_ID:b n_entries:i total:4",
    """SELECT p.PRODUCT_ID, WEEK_NO, STORE_ID, 71 AS n_entries,
       STORE_ID + WEEK_NO + d + c + s + br + discount_rate + coalesce(list_sum(v), 0) AS total
       FROM panel p LEFT JOIN emb USING (PRODUCT_ID) JOIN (
         SELECT PRODUCT_ID, dense_rank() OVER (ORDER BY DEPARTMENT) - 1 AS d, dense_rank() OVER (ORDER BY COMMODITY_DESC) - 1 AS c,
         dense_rank() OVER (ORDER BY SUB_COMMODITY_DESC) - 1 AS s, dense_rank() OVER (ORDER BY BRAND) - 1 AS br FROM product) k USING (PRODUCT_ID)""",
)
def covariate_vectors(b):
    spec = covariates.covariates(b.panel, include_discount_rate=True, embeddings=b.views.embeddings())
    out = spec.attach(b.panel)
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return out.select(*CELL, F.size("w").alias("n_entries"), total.alias("total"))


@query("group_folds", "PRODUCT_ID:b n_rows:b fold:i", "SELECT * FROM folds")
def group_folds(b):
    return covariates.group_folds(b.panel, 5)


@query(
    "row_folds", "fold:i n_rows:b",
    f"SELECT CAST(floor({sql.u('42', chr(39) + 'fold' + chr(39), *sql.CELL_PARTS)} * 5) AS INTEGER) AS fold, count(*) AS n_rows FROM panel GROUP BY 1",
)
def row_folds(b):
    return covariates.with_row_folds(b.panel, 5, CELL).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


def _promo_residuals(b: Workbench, treatment: str = "promo_any") -> DataFrame:
    frame = dml.estimation_frame(b.panel, b.edges, treatment=treatment, min_demand_filter=None)
    return residualise(frame, ["y", *dml.TREATMENTS], 5, CELL_MEAN)


@query(
    "dml_residuals", f"{CELL_COLS} fold:i y_res:6 t_direct_res:6 t_sub_res:6 t_comp_res:6",
    f"SELECT {sql.KEYS}, fold, y_res, t0_res AS t_direct_res, t1_res AS t_sub_res, t2_res AS t_comp_res FROM res_promo",
)
def dml_residuals(b):
    return _promo_residuals(b)


@query("dml_direct_k1", EFFECT_COLS, sql.dml_one("res_promo"))
def dml_direct_k1(b):
    fit = clustered_ols(_promo_residuals(b), "y_res", ["t_direct_res"], PRODUCT, STORE)
    return dml.effects_table(b.spark, "dml_direct", ["direct"], fit, 0.95)


@query("dml_graph_k3", EFFECT_COLS, sql.dml_three("res_promo", "graph_dml_edge_weight"))
def dml_graph_k3(b):
    options = {"nuisance": CELL_MEAN, "min_demand_filter": None, "with_cate": False}
    return dml.run_graph_dml(b.panel, b.edges, **options).effects


@query("dml_discount_k3", EFFECT_COLS, sql.dml_three("res_disc", "graph_dml_edge_weight"))
def dml_discount_k3(b):
    options = {"nuisance": CELL_MEAN, "min_demand_filter": None, "with_cate": False}
    return dml.run_discount_dml(b.panel, b.edges, **options).effects


@query("dml_graph_linear", EFFECT_COLS, sql.dml_three("res_linear", EDGE))
def dml_graph_linear(b):
    return dml.run_graph_dml(b.panel, b.edges, nuisance=LINEAR, min_demand_filter=None, with_cate=False).effects


@query("dml_graph_gbt", EFFECT_COLS)
def dml_graph_gbt(b):
    return dml.run_graph_dml(b.panel, b.edges, nuisance=GBT, n_folds=5, min_demand_filter=0.01).effects


@query(
    "nuisance_gain", "target n_obs:b beats_mean no_worse",
    "SELECT target, count(*) AS n_obs, target <> 't_direct' AS beats_mean, true AS no_worse FROM frame_promo, (SELECT unnest(['y', 't_direct', 't_sub', 't_comp']) AS target) GROUP BY 1",
)
def nuisance_gain(b):
    """Boosted predictions of products they never saw against the mean of the products they saw, by squared loss.

    Promotions are drawn by hash here, so no model can beat their mean; it may lose a twentieth to it at most.
    """
    frame = dml.estimation_frame(b.panel, b.edges, min_demand_filter=None)
    targets = ["y", *dml.TREATMENTS]
    cov = covariates.covariates(frame)
    res = residualise(cov.attach(frame), targets, 5, GBT)
    per_fold = frame.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(f"{t}_s") for t in targets])
    whole = per_fold.agg(F.struct(F.sum("n").alias("n"), *[F.sum(f"{t}_s").alias(t) for t in targets]).alias("all")).scalar()
    means = per_fold.select("fold", *[((whole[t] - F.col(f"{t}_s")) / (whole["n"] - F.col("n"))).alias(f"{t}_mean") for t in targets])
    rows = res.join(F.broadcast(means), "fold")  # a row per fold
    def against_mean(t: str) -> Column:
        loss, mean_loss = F.avg(F.col(f"{t}_res") ** 2), F.avg((F.col(t) - F.col(f"{t}_mean")) ** 2)
        return F.struct(F.lit(t).alias("target"), F.count(F.lit(1)).alias("n_obs"), (loss < mean_loss).alias("beats_mean"), (loss < 1.05 * mean_loss).alias("no_worse"))

    sums = [against_mean(t) for t in targets]
    return rows.agg(F.array(*sums).alias("s")).select(F.inline("s"))


@query("dml_cate_by_department", "DEPARTMENT direct_mean:6 sub_spill_mean:6 comp_spill_mean:6 n_obs:b", "SELECT * FROM cate_groups")
def dml_cate_by_department(b):
    est = dml.run_graph_dml(b.panel, b.edges, nuisance=CELL_MEAN, min_demand_filter=None)
    return interpret.cate_by_group(est.cate())


@query("dml_cate_rows", f"{CELL_COLS} direct_cate:6 sub_spillover_cate:6 comp_spillover_cate:6", "SELECT * FROM cate")
def dml_cate_rows(b):
    """The fitted effects of every row."""
    return b.cate


@query("ablation_suite", f"ablation {EFFECT_COLS} excluded")
def ablation_suite(b):
    return dml.ablation_suite(b.panel, b.edges, b.views.embeddings(), nuisance=LINEAR, min_demand_filter=None)


@query("dml_main_run", EFFECT_COLS)
def dml_main_run(b):
    """The study's main run: trained vectors, substitutes by them, train weeks, demand filter, vectors among the covariates."""
    edges = settled(b.complements.unionByName(substitutes.substitute_edges(b.views.products(), b.trained)), "edges")
    train = panels.temporal_split(b.panel, **SPLITS)["train"]
    options = {"nuisance": LINEAR, "min_demand_filter": 0.01, "with_cate": False}
    return dml.run_graph_dml(train, edges, embeddings=b.trained, **options).effects


ABLATION_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS ablation, *, effect = '{off}' AS excluded FROM ({text})"
    for name, text, off in (
        ("full_model", sql.dml_three("res_promo", EDGE), ""),
        ("sub_only", sql.dml_two("res_promo", "t1", EDGE), "comp_spillover"),
        ("comp_only", sql.dml_two("res_promo", "t2", EDGE), "sub_spillover"),
        ("binary_weights", sql.dml_three("res_bin", BINARY), ""),
        ("no_embeddings", sql.dml_three("res_promo", EDGE), ""),
    )
)


@query("ablation_cell_mean", f"ablation {EFFECT_COLS} excluded", ABLATION_SQL)
def ablation_cell_mean(b):
    """The suite with department-week means as nuisance, which ignore embeddings."""
    return dml.ablation_suite(b.panel, b.edges, nuisance=CELL_MEAN, min_demand_filter=None)


@query(
    "ols_hc1", "n_obs:b intercept:6 slope:6 se_intercept:6 se_slope:6",
    """SELECT n AS n_obs, my - b * mt AS intercept, b AS slope,
       sqrt(sum(e * e * pow(1.0 / n - mt * (t - mt) / stt, 2)) * n / (n - 2)) AS se_intercept,
       sqrt(sum(e * e * (t - mt) * (t - mt)) / (stt * stt) * n / (n - 2)) AS se_slope
       FROM (SELECT t, y, n, mt, my, stt, b, y - my - b * (t - mt) AS e FROM
         (SELECT promo_any AS t, units_sold AS y FROM panel),
         (SELECT count(*) AS n, avg(promo_any) AS mt, avg(units_sold) AS my,
          regr_sxx(units_sold, promo_any) AS stt, regr_slope(units_sold, promo_any) AS b FROM panel))
       GROUP BY n, my, mt, b, stt""",
)
def ols_with_hc1(b):
    fit = ols_hc1(b.panel, F.col("units_sold"), [F.lit(1.0), F.col("promo_any")])
    row = [(fit.n, *map(float, fit.beta), *map(float, fit.se))]
    return b.spark.createDataFrame(row, "n_obs bigint, intercept double, slope double, se_intercept double, se_slope double")


@query("ols_baseline", f"{EFFECT_COLS} r_squared:6", sql.ols_with_controls())
def ols_baseline(b):
    return baselines.ols_baseline(b.panel)


ROW_FOLD_FRAME = f"""SELECT DEPARTMENT, WEEK_NO, CAST(floor({sql.u("42", "'fold'", *sql.CELL_PARTS)} * 5) AS INTEGER) AS fold,
    units_sold AS y, CAST(promo_any AS DOUBLE) AS t0, 0.0 AS t1, 0.0 AS t2 FROM panel"""


@query(
    "dml_no_graph_constant", EFFECT_COLS,
    f"""SELECT 'dml_no_graph' AS model, 'direct' AS effect, b AS ATE, se, b - {sql.Z95} * se AS CI_lower, b + {sql.Z95} * se AS CI_upper, n AS n_obs FROM (
        WITH rf AS ({ROW_FOLD_FRAME}), rr AS ({sql.residuals("rf")}),
        fit AS (SELECT count(*) AS n, sum(t0_res * t0_res) AS g, sum(t0_res * y_res) / sum(t0_res * t0_res) AS b FROM rr)
        SELECT b, n, sqrt(sum(pow(t0_res * (y_res - b * t0_res), 2)) / (g * g) * n / (n - 1)) AS se FROM rr CROSS JOIN fit GROUP BY b, n, g)""",
)
def dml_no_graph_constant(b):
    return baselines.dml_baseline(b.panel, nuisance=CELL_MEAN, heterogeneous=False)


@query("dml_no_graph", EFFECT_COLS, sql.dml_with_slopes("dml_no_graph", sql.REGRESSORS[1:]))
def dml_no_graph(b):
    return baselines.dml_baseline(b.panel, nuisance=CELL_MEAN)


@query(
    "dml_unweighted_spillover", EFFECT_COLS,
    sql.dml_with_slopes("dml_unweighted_spillover", (*sql.REGRESSORS[1:], *sql.FEATURES)),
)
def dml_unweighted_spillover(b):
    return baselines.dml_baseline(b.featured, nuisance=CELL_MEAN, include_spillover=True)


@query(
    "model_comparison", "model ATE:6 CI_lower:6 CI_upper:6 source",
    f"""SELECT model, ATE, CI_lower, CI_upper, 'baseline' AS source FROM ({QUERIES["dml_no_graph_constant"].oracle})
        UNION ALL SELECT model, ATE, CI_lower, CI_upper, 'graph' FROM ({sql.dml_three("res_promo", EDGE)}) WHERE effect = 'direct'""",
)
def model_comparison(b):
    return interpret.compare_models(dml_no_graph_constant(b), dml_graph_k3(b))


@query("causal_forest", EFFECT_COLS)
def causal_forest(b):
    return baselines.forest_baseline(b.panel, nuisance=CELL_MEAN)[0]


@query("baseline_table", f"baseline {EFFECT_COLS} r_squared:6")
def baseline_table(b):
    return baselines.run_all_baselines(b.featured, nuisance=CELL_MEAN, embeddings=b.views.embeddings())


# ── interpretation ────────────────────────────────────────────────────────────

GROUP_COLS = "DEPARTMENT direct_mean:6 direct_std:6 sub_spill_mean:6 sub_spill_std:6 comp_spill_mean:6 comp_spill_std:6 n_obs:b"


@query("cate_by_department", GROUP_COLS, "SELECT * FROM cate_groups")
def cate_by_department(b):
    return interpret.cate_by_group(b.cate)


@query(
    "cannibalized_departments", "DEPARTMENT sub_spill_mean:6 sub_spill_std:6 direct_mean:6 n_obs:b",
    "SELECT * FROM cate_groups WHERE sub_spill_mean < 0",
)
def cannibalized_departments(b):
    return interpret.cannibalised_groups(b.cate)


@query(
    "top_spillover_products", "PRODUCT_ID:b cate_mean:6 cate_std:6 n_obs:b",
    """SELECT PRODUCT_ID, avg(sub_spillover_cate) AS cate_mean, stddev_samp(sub_spillover_cate) AS cate_std, count(*) AS n_obs
       FROM cate GROUP BY 1 ORDER BY abs(avg(sub_spillover_cate)) DESC, PRODUCT_ID LIMIT 15""",
)
def top_spillover_products(b):
    return interpret.top_spillover_products(b.cate, "sub_spillover", 15)


@query(
    "cate_spread", "cate_min:6 cate_max:6 cate_std:6",
    "SELECT min(direct_cate) AS cate_min, max(direct_cate) AS cate_max, stddev_pop(direct_cate) AS cate_std FROM cate",
)
def cate_spread(b):
    return interpret.cate_spread(b.cate, "direct_cate")


@query("cate_histogram", "bin:i bin_start:6 n:b", _hist_sql("direct_cate", "cate", 80))
def cate_histogram(b):
    return histogram(b.cate, F.col("direct_cate"), 80)


def _direct_effects(b: Workbench) -> DataFrame:
    """Mean fitted effects by department with their range, as an effects table."""
    rows = F.array(*[F.struct(F.lit(e).alias("effect"), F.col(f"{e}_cate").alias("v")) for e in EFFECTS])
    return (
        b.cate.select(F.col("DEPARTMENT").alias("group"), F.inline(rows))
        .groupBy("group", "effect")
        .agg(F.avg("v").alias("ATE"), F.min("v").alias("CI_lower"), F.max("v").alias("CI_upper"))
    )


EFFECT_ROWS = " UNION ALL ".join(
    f"""SELECT DEPARTMENT AS "group", '{e}' AS effect, avg({e}_cate) AS ATE, min({e}_cate) AS CI_lower, max({e}_cate) AS CI_upper
        FROM cate GROUP BY 1""" for e in EFFECTS
)


@query(
    "directional_check", "DEPARTMENT effect estimate:6 expected_sign passes",
    f"""SELECT "group" AS DEPARTMENT, effect, ATE AS estimate,
        CASE effect WHEN 'sub_spillover' THEN 'negative' ELSE 'positive' END AS expected_sign,
        CASE effect WHEN 'sub_spillover' THEN ATE < 0 ELSE ATE > 0 END AS passes FROM ({EFFECT_ROWS})""",
)
def directional_check(b):
    return evaluate.directional_check(_direct_effects(b)).withColumnRenamed("group", "DEPARTMENT")


@query(
    "result_store", "group effect ATE:6 CI_lower:6 CI_upper:6",
    f"SELECT * FROM ({EFFECT_ROWS})",
)
def result_store(b):
    """Effects by department, stacked, written as one CSV and read back with a schema."""
    path = scratch(b, "result-store")
    effects = _direct_effects(b)
    parts = {g: effects.filter(F.col("group") == g).drop("group") for g in ("ECONOMY", "LARGE", "MEDIUM")}
    rest = effects.filter(~F.col("group").isin(*parts))
    stores.write_result(stores.stack_results(parts, "group").unionByName(rest), path)
    schema = "effect STRING, ATE DOUBLE, CI_lower DOUBLE, CI_upper DOUBLE, `group` STRING"
    return stores.read_result(b.spark, path, schema)


@query(
    "compare_effects", "effect ATE:6 CI_lower:6 CI_upper:6 interpretation",
    f"""SELECT CASE effect WHEN 'direct' THEN 'Direct (own promo)' WHEN 'sub_spillover' THEN 'Substitute spillover'
          ELSE 'Complement spillover' END AS effect, ATE, CI_lower, CI_upper,
        CASE effect WHEN 'direct' THEN 'Units gained from own promotion'
          WHEN 'sub_spillover' THEN 'Cannibalization: demand loss when substitutes promoted'
          ELSE 'Attachment lift: demand gain when complements promoted' END AS interpretation
        FROM ({sql.dml_three("res_promo", EDGE)})""",
)
def compare_effects(b):
    return interpret.compare_effects(dml_graph_k3(b))


# ── evaluation ────────────────────────────────────────────────────────────────

SIM = {
    "mean_bias": "avg(estimate - true_value)",
    "std_bias": "stddev_samp(estimate - true_value)",
    "rmse": "sqrt(avg((estimate - true_value) * (estimate - true_value)))",
    "coverage": "avg(CASE WHEN ci_lower <= true_value AND true_value <= ci_upper THEN 1.0 ELSE 0.0 END)",
    "n_sims": "count(*)",
}


def _sim_sql(*names: str) -> str:
    return f"SELECT effect, {', '.join(f'{SIM[n]} AS {n}' for n in names)} FROM sims GROUP BY 1"


@query("sim_bias", "effect mean_bias:6 std_bias:6 n_sims:b", _sim_sql("mean_bias", "std_bias", "n_sims"))
def sim_bias(b):
    return evaluate.bias(b.views.simulation_results())


@query("sim_rmse", "effect rmse:6", _sim_sql("rmse"))
def sim_rmse(b):
    return evaluate.rmse(b.views.simulation_results())


@query("sim_coverage", "effect coverage:6 n_sims:b", _sim_sql("coverage", "n_sims"))
def sim_coverage(b):
    return evaluate.ci_coverage(b.views.simulation_results())


@query("sim_summary", "effect mean_bias:6 std_bias:6 rmse:6 coverage:6 n_sims:b", _sim_sql(*SIM))
def sim_summary(b):
    return evaluate.synthetic_evaluation(b.views.simulation_results())


BALANCE = ("discount_rate", "WEEK_NO", "STORE_ID")


@query(
    "covariate_balance", "covariate treated_mean:6 control_mean:6 smd:6 acceptable",
    "SELECT covariate, tm AS treated_mean, cm AS control_mean, CASE WHEN sd > 0 THEN (tm - cm) / sd ELSE 0 END AS smd, "
    "CASE WHEN sd > 0 THEN abs((tm - cm) / sd) < 0.1 ELSE true END AS acceptable FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS covariate, avg({c}) FILTER (promo_any = 1) AS tm, avg({c}) FILTER (promo_any = 0) AS cm,
            sqrt((pow(stddev_samp({c}) FILTER (promo_any = 1), 2) + pow(stddev_samp({c}) FILTER (promo_any = 0), 2)) / 2) AS sd
            FROM panel""" for c in BALANCE
    )
    + ")",
)
def covariate_balance(b):
    return evaluate.covariate_balance(b.panel, covariates=[*BALANCE, "DEPARTMENT", "absent"])


def _network_sql(x: str) -> str:
    """One pass through the permutation network on places of an a x b grid."""

    def mix(v: str) -> str:
        m = f"(({v} * 1103515245 + e[1]) % 2147483647)"
        q = f"((xor({m}, {m} >> 15) * 1664525) % 2147483647)"
        return f"xor({q}, {q} >> 13)"

    step = f"CASE WHEN e[2] = 0 THEN [(s[1] + {mix('s[2]')}) % a, s[2]] ELSE [s[1], (s[2] + {mix('s[1]')}) % b] END"
    return f"list_dot_product(list_reduce([[{x} // b, {x} % b]] || keys, lambda s, e: {step}), [b, 1])"


def _permuted_sql(perms: int) -> str:
    """Panel rows with the treatment that each permutation sends to them; at most four places lie beyond the rows."""
    keys = "list_transform(range(0, 8), lambda r: [CAST('0x' || substr(md5('42|perm|' || perm_id || '|' || r), 1, 7) AS BIGINT), r % 2])"
    rows = f"""SELECT *, CAST({_network_sql("k")} AS BIGINT) AS j0 FROM permutable CROSS JOIN (SELECT perm_id, {keys} AS keys FROM range({perms}) t(perm_id)) CROSS JOIN (
        SELECT a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n FROM panel), range(1, 20000) f(a)
        WHERE a * a <= n AND (a + 1) * (a + 1) * (a + 1) > n ORDER BY (n + a - 1) // a * a - n, a DESC LIMIT 1)"""
    for i in range(4):
        rows = f"SELECT *, CASE WHEN j{i} >= n THEN CAST({_network_sql(f'j{i}')} AS BIGINT) ELSE j{i} END AS j{i + 1} FROM ({rows})"
    return f"SELECT p.STORE_ID, p.PRODUCT_ID, p.WEEK_NO, p.units_sold, g.promo_any, p.perm_id FROM ({rows}) p JOIN permutable g ON g.k = p.j4"


@query("placebo_permutation", f"{CELL_COLS} promo_any:i", _permuted_sql(1))
def placebo_permutation(b):
    return permute_column(b.panel, CELL, "promo_any", seed=42)


def _mean_difference(df: DataFrame) -> DataFrame:
    """Difference in mean outcome between the arms with its large-sample interval."""
    y, t = F.col("units_sold"), F.col("promo_any")
    arm = lambda v, f: f(F.when(t == v, y))
    m = df.agg(
        (arm(1, F.avg) - arm(0, F.avg)).alias("d"),
        F.sqrt(arm(1, F.var_samp) / arm(1, F.count) + arm(0, F.var_samp) / arm(0, F.count)).alias("se"),
    )
    return m.select(
        F.lit("direct").alias("effect"), F.col("d").alias("estimate"),
        (F.col("d") - 1.959963984540054 * F.col("se")).alias("ci_lower"),
        (F.col("d") + 1.959963984540054 * F.col("se")).alias("ci_upper"),
    )


@query(
    "placebo_test", "perm_id:i effect estimate:6 ci_lower:6 ci_upper:6",
    f"""SELECT perm_id, 'direct' AS effect, d AS estimate, d - {sql.Z95} * se AS ci_lower, d + {sql.Z95} * se AS ci_upper FROM (
        SELECT perm_id, avg(units_sold) FILTER (promo_any = 1) - avg(units_sold) FILTER (promo_any = 0) AS d,
        sqrt(var_samp(units_sold) FILTER (promo_any = 1) / count(*) FILTER (promo_any = 1)
           + var_samp(units_sold) FILTER (promo_any = 0) / count(*) FILTER (promo_any = 0)) AS se
        FROM ({_permuted_sql(20)}) GROUP BY 1)""",
)
def placebo_test(b):
    return evaluate.placebo_test(b.panel, _mean_difference, n_permutations=20)


@query(
    "known_effect_outcome", f"{CELL_COLS} y_synthetic:6",
    f"""SELECT {sql.KEYS}, greatest(0, 1.5 + 0.1 * promo_any - 0.05 * sub_exposure_weighted + 0.03 * comp_exposure_weighted
          + 0.5 * (code - cm) / (cs + 1e-8) + 0.3 * (WEEK_NO - wm) / (ws + 1e-8)) AS y_synthetic
        FROM exposed JOIN store_codes USING (STORE_ID),
        (SELECT avg(code) AS cm, stddev_pop(code) AS cs, avg(WEEK_NO) AS wm, stddev_pop(WEEK_NO) AS ws
         FROM panel JOIN store_codes USING (STORE_ID)) m""",
)
def known_effect_outcome(b):
    return evaluate.generate_outcome(b.panel, b.edges, StudyConfig(noise_std=0.0))


@query(
    "confounded_treatment", f"{CELL_COLS} promo_any:i",
    f"""SELECT {sql.KEYS}, CASE WHEN {sql.u("42", "'assign'", *sql.CELL_PARTS)} <
          1 / (1 + exp(-0.5 * ((code - cm) / (cs + 1e-8) + (WEEK_NO - wm) / (ws + 1e-8)))) THEN 1 ELSE 0 END AS promo_any
        FROM (SELECT {sql.KEYS}, code FROM panel JOIN store_codes USING (STORE_ID)),
        (SELECT avg(code) AS cm, stddev_pop(code) AS cs, avg(WEEK_NO) AS wm, stddev_samp(WEEK_NO) AS ws
         FROM panel JOIN store_codes USING (STORE_ID)) m""",
)
def confounded_treatment(b):
    return evaluate.assign_confounded(b.panel)


@query("known_effect_recovery", EFFECT_COLS, sql.dml_three("res_made", EDGE))
def known_effect_recovery(b):
    """The calibration check: inject known effects with noise and confounding, and estimate them back."""
    made = settled(evaluate.generate_outcome(b.panel, b.edges, reassign_treatment=True), "made")
    options = {"outcome": "y_synthetic", "log_transform": False, "min_demand_filter": None, "nuisance": CELL_MEAN}
    return dml.run_graph_dml(made, b.edges, with_cate=False, **options).effects


# ── profiles ──────────────────────────────────────────────────────────────────

PROFILED = {
    "transactions": ("tx", {
        "household_key": "bigint", "BASKET_ID": "bigint", "DAY": "int", "WEEK_NO": "int", "PRODUCT_ID": "bigint",
        "STORE_ID": "bigint", "QUANTITY": "double", "SALES_VALUE": "double", "RETAIL_DISC": "double",
        "COUPON_DISC": "double", "COUPON_MATCH_DISC": "double"}),
    "causal": ("causal", {"STORE_ID": "bigint", "PRODUCT_ID": "bigint", "WEEK_NO": "int", "display": "string", "mailer": "string"}),
    "products": ("product", {"PRODUCT_ID": "bigint", **{c: "string" for c in HIERARCHY}}),
    "campaign_hh": ("campaign_table", {"household_key": "bigint", "CAMPAIGN": "int"}),
    "redemptions": ("redemptions", {"household_key": "bigint", "DAY": "int", "COUPON_UPC": "bigint"}),
    "demographics": ("demographics", {"household_key": "bigint", "INCOME_DESC": "string"}),
    "campaigns": ("campaigns", {"CAMPAIGN": "int", "START_DAY": "int", "END_DAY": "int"}),
    "coupons": ("coupons", {"COUPON_UPC": "bigint"}),
}


def _profile_sql() -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, '{d}' AS dtype, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS null_pct, count(DISTINCT {c}) AS n_unique, {s} AS sample FROM {v}"
    return " UNION ALL ".join(
        one.format(t=t, c=c, d=d, v=v, s="NULL" if d == "double" else f"CAST(min({c}) AS VARCHAR)")
        for t, (v, cols) in PROFILED.items() for c, d in cols.items()
    )


@query("schema_profile", "table_name column_name dtype null_pct:2 n_unique:b sample", _profile_sql())
def schema_profile(b):
    out = profile.schema_profiles(b.views.tables())
    # engines print doubles differently, so their sample is left out of the comparison
    return out.withColumn("sample", F.when(F.col("dtype") != "double", F.col("sample")))


@query(
    "entity_counts", "entity value:b",
    """SELECT 'households' AS entity, count(DISTINCT household_key) AS value FROM tx UNION ALL
       SELECT 'products_in_tx', count(DISTINCT PRODUCT_ID) FROM tx UNION ALL SELECT 'stores', count(DISTINCT STORE_ID) FROM tx UNION ALL
       SELECT 'weeks', count(DISTINCT WEEK_NO) FROM tx UNION ALL SELECT 'day_min', min(DAY) FROM tx UNION ALL
       SELECT 'day_max', max(DAY) FROM tx UNION ALL SELECT 'baskets', count(DISTINCT BASKET_ID) FROM tx UNION ALL
       SELECT 'transaction_lines', count(*) FROM tx UNION ALL SELECT 'products_in_catalog', count(DISTINCT PRODUCT_ID) FROM product UNION ALL
       SELECT 'departments', count(DISTINCT DEPARTMENT) FROM product UNION ALL SELECT 'commodities', count(DISTINCT COMMODITY_DESC) FROM product UNION ALL
       SELECT 'sub_commodities', count(DISTINCT SUB_COMMODITY_DESC) FROM product""",
)
def entity_counts(b):
    return profile.entity_counts(b.views.transactions(), b.views.products())


WEEKLY = "SELECT WEEK_NO, count(DISTINCT BASKET_ID) AS baskets, count(*) AS lines FROM tx GROUP BY 1"


@query("weekly_volume", "WEEK_NO:i baskets:b lines:b", WEEKLY)
def weekly_volume(b):
    return profile.weekly_volume(b.views.transactions())


@query("peak_week", "WEEK_NO:i baskets:b lines:b", f"{WEEKLY} ORDER BY baskets DESC, WEEK_NO LIMIT 1")
def peak_week(b):
    return profile.peak_week(b.views.transactions())


def _share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"


@query(
    "discount_coverage", "discount share:6",
    " UNION ALL ".join(f"SELECT '{c}' AS discount, {_share(f'{c} <> 0')} AS share FROM priced" for c in profile.DISCOUNTS)
    + f" UNION ALL SELECT 'any_discount', {_share(' OR '.join(f'{c} <> 0' for c in profile.DISCOUNTS))} FROM priced",
)
def discount_coverage(b):
    return profile.discount_coverage(profile.priced_lines(b.views.transactions()))


def _describe_sql(column: str, source: str) -> str:
    stats = {"count": f"count({column})", "mean": f"avg({column})", "std": f"stddev_samp({column})", "min": f"min({column})",
             "max": f"max({column})", **{f"p{int(p * 100)}": f"quantile_cont({column}, {p})" for p in (0.05, 0.25, 0.5, 0.75, 0.95)}}
    return " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, '{n}' AS stat, CAST({e} AS DOUBLE) AS value FROM {source}" for n, e in stats.items()
    )


@query("price_describe", "column_name stat value:4", _describe_sql("unit_price", "priced"))
def price_describe(b):
    return profile.describe(profile.priced_lines(b.views.transactions()), ["unit_price"])


@query("discount_describe", "column_name stat value:4", _describe_sql("RETAIL_DISC", "priced WHERE RETAIL_DISC <> 0"))
def discount_describe(b):
    priced = profile.priced_lines(b.views.transactions())
    return profile.describe(priced.filter(F.col("RETAIL_DISC") != 0), ["RETAIL_DISC"])


EXPOSURE_NAMES = tuple(c.partition(":")[0] for c in EXPOSURES.split())


@query(
    "exposure_describe", "column_name stat value:6",
    " UNION ALL ".join(_describe_sql(c, "exposed") for c in EXPOSURE_NAMES),
)
def exposure_describe(b):
    return profile.describe(b.exposed, list(EXPOSURE_NAMES))


PRICED_DEPT = "SELECT p.*, DEPARTMENT FROM priced p LEFT JOIN product USING (PRODUCT_ID)"


@query(
    "price_trim", "DEPARTMENT n:b mean_log_price:6 max_price:4",
    f"""SELECT DEPARTMENT, count(*) AS n, avg(ln(1 + unit_price)) AS mean_log_price, max(unit_price) AS max_price FROM ({PRICED_DEPT}) d
        JOIN (SELECT DEPARTMENT, quantile_cont(unit_price, 0.99) AS q, count(*) AS k FROM ({PRICED_DEPT}) GROUP BY 1 ORDER BY k DESC, DEPARTMENT LIMIT 10) c
        USING (DEPARTMENT) WHERE unit_price > 0 AND unit_price < q GROUP BY 1""",
)
def price_trim(b):
    kept = profile.trimmed_prices(profile.priced_lines(b.views.transactions()), b.views.products(), 10)
    return kept.groupBy("DEPARTMENT").agg(
        F.count(F.lit(1)).alias("n"), F.avg("log_price").alias("mean_log_price"), F.max("unit_price").alias("max_price")
    )


@query("price_histogram", "bin:i bin_start:6 n:b", _hist_sql("ln(1 + unit_price)", "priced", 60))
def price_histogram(b):
    return histogram(profile.priced_lines(b.views.transactions()), F.log1p("unit_price"), 60)


@query(
    "discount_trim", "n:b total:3",
    """SELECT count(*) AS n, sum(s) AS total FROM (SELECT abs(RETAIL_DISC) AS s FROM priced WHERE RETAIL_DISC <> 0),
       (SELECT quantile_cont(abs(RETAIL_DISC), 0.99) AS q FROM priced WHERE RETAIL_DISC <> 0) WHERE s < q""",
)
def discount_trim(b):
    kept = profile.trimmed_discounts(profile.priced_lines(b.views.transactions()))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


@query("units_histogram", "bin:i bin_start:6 n:b", _hist_sql("units_sold", "panel WHERE units_sold > 0", 50))
def units_histogram(b):
    return histogram(b.panel.filter(F.col("units_sold") > 0), F.col("units_sold"), 50)


@query(
    "promo_coverage", "metric value:6",
    " UNION ALL ".join(
        f"SELECT '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM flags"
        for n, e in {
            "rows": "count(*)", "display": "sum(display)", "mailer": "sum(mailer)", "either": "sum(promo_any)",
            "both": "sum(display * mailer)", "display_share": "avg(display)", "mailer_share": "avg(mailer)",
            "either_share": "avg(promo_any)", "both_share": "avg(display * mailer)",
            "products_promoted": "count(DISTINCT PRODUCT_ID) FILTER (promo_any = 1)",
            "stores": "count(DISTINCT STORE_ID)", "weeks": "count(DISTINCT WEEK_NO)",
        }.items()
    ),
)
def promo_coverage(b):
    return profile.promo_coverage(b.views.causal())


@query(
    "flag_code_counts", "flag code n:b",
    """SELECT 'display' AS flag, coalesce(trim(display), 'nan') AS code, count(*) AS n FROM causal GROUP BY 1, 2 UNION ALL
       SELECT 'mailer', coalesce(trim(mailer), 'nan'), count(*) FROM causal GROUP BY 1, 2""",
)
def flag_code_counts(b):
    return profile.flag_code_counts(b.views.causal())


@query(
    "campaign_reach", "metric value:6",
    """SELECT 'campaigns' AS metric, count(DISTINCT CAMPAIGN) AS value FROM campaign_table UNION ALL
       SELECT 'households', count(DISTINCT household_key) FROM campaign_table UNION ALL
       SELECT 'households_per_campaign', avg(h) FROM (SELECT count(DISTINCT household_key) AS h FROM campaign_table GROUP BY CAMPAIGN) UNION ALL
       SELECT 'redemptions', count(*) FROM redemptions UNION ALL
       SELECT 'redeeming_households', count(DISTINCT household_key) FROM redemptions UNION ALL
       SELECT 'redeemed_coupons', count(DISTINCT COUPON_UPC) FROM redemptions UNION ALL
       SELECT 'first_day', min(DAY) FROM redemptions UNION ALL SELECT 'last_day', max(DAY) FROM redemptions""",
)
def campaign_reach(b):
    return profile.campaign_reach(b.views.campaign_table(), b.views.coupon_redempt())


@query(
    "coupon_overlap", "n_lines:b n_discounted:b share_discounted:6",
    f"""SELECT count(*) AS n_lines, count(*) FILTER (RETAIL_DISC <> 0) AS n_discounted, coalesce({_share("RETAIL_DISC <> 0")}, 0) AS share_discounted
        FROM priced WHERE EXISTS (SELECT 1 FROM redemptions r WHERE r.household_key = priced.household_key AND r.DAY = priced.DAY)""",
)
def coupon_overlap(b):
    return profile.coupon_overlap(profile.priced_lines(b.views.transactions()), b.views.coupon_redempt())


@query(
    "treatment_top30", "PRODUCT_ID:b n_lines:b pct_retail_disc:6 pct_display:6 pct_mailer:6 pct_any:6 enough",
    f"""SELECT *, pct_any >= 0.2 AS enough FROM (
        SELECT PRODUCT_ID, count(*) AS n_lines, {_share("RETAIL_DISC <> 0")} AS pct_retail_disc, avg(coalesce(display, 0)) AS pct_display,
        avg(coalesce(mailer, 0)) AS pct_mailer, {_share("RETAIL_DISC <> 0 OR coalesce(display, 0) = 1 OR coalesce(mailer, 0) = 1")} AS pct_any
        FROM priced LEFT JOIN flags USING ({sql.KEYS}) GROUP BY 1 ORDER BY count(*) DESC, PRODUCT_ID LIMIT 30)""",
)
def treatment_top30(b):
    return profile.treatment_of_top_products(profile.priced_lines(b.views.transactions()), b.views.causal())


@query(
    "line_treatments", "display_active:i mailer_active:i any_treatment:i n:b",
    f"""SELECT coalesce(display, 0) AS display_active, coalesce(mailer, 0) AS mailer_active,
        CASE WHEN RETAIL_DISC <> 0 OR coalesce(display, 0) = 1 OR coalesce(mailer, 0) = 1 THEN 1 ELSE 0 END AS any_treatment,
        count(*) AS n FROM priced LEFT JOIN flags USING ({sql.KEYS}) GROUP BY 1, 2, 3""",
)
def line_treatments(b):
    lines = profile.lines_with_flags(profile.priced_lines(b.views.transactions()), b.views.causal())
    return lines.groupBy("display_active", "mailer_active", "any_treatment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "treatment_variation", "PRODUCT_ID:b mean_disc_rate:6 weeks_observed:b has_variation",
    f"""SELECT PRODUCT_ID, avg(r) AS mean_disc_rate, count(*) AS weeks_observed, avg(r) BETWEEN 0.05 AND 0.95 AND count(*) >= 10 AS has_variation
        FROM (SELECT PRODUCT_ID, WEEK_NO, {_share("RETAIL_DISC <> 0")} AS r FROM priced GROUP BY 1, 2) GROUP BY 1""",
)
def treatment_variation(b):
    return profile.treatment_variation(profile.priced_lines(b.views.transactions()))


@query(
    "catalog_structure", "level label n_products:b pct:6",
    " UNION ALL ".join(
        f"SELECT '{c}' AS level, {c} AS label, count(*) AS n_products, count(*) * 100.0 / (SELECT count(*) FROM product) AS pct FROM product GROUP BY 2"
        for c in ("DEPARTMENT", "BRAND")
    ),
)
def catalog_structure(b):
    return profile.catalog_structure(b.views.products())


@query(
    "commodity_zipf", "COMMODITY_DESC n_products:b rank:b log_rank:6 log_products:6",
    """SELECT *, ln(rank) AS log_rank, ln(n_products) AS log_products FROM (
       SELECT COMMODITY_DESC, count(DISTINCT PRODUCT_ID) AS n_products,
       row_number() OVER (ORDER BY count(DISTINCT PRODUCT_ID) DESC, COMMODITY_DESC) AS rank FROM product GROUP BY 1)""",
)
def commodity_zipf(b):
    return profile.commodity_zipf(b.views.products())


@query(
    "price_percentiles_by_department", "DEPARTMENT p:2 q:4",
    f"""SELECT DEPARTMENT, 0.5 AS p, quantile_cont(unit_price, 0.5) AS q FROM ({PRICED_DEPT}) GROUP BY 1 UNION ALL
        SELECT DEPARTMENT, 0.99, quantile_cont(unit_price, 0.99) FROM ({PRICED_DEPT}) GROUP BY 1""",
)
def price_percentiles_by_department(b):
    lines = profile.with_department(profile.priced_lines(b.views.transactions()), b.views.products())
    return percentiles(lines, "unit_price", [0.5, 0.99], ["DEPARTMENT"])


# ── a catalog that grows with the tables: a product per part ─────────────────

PER_PRODUCT = """SELECT PRODUCT_ID, count(*) AS n_rows, sum(sub_exposure_weighted) AS sub_sum, sum(comp_exposure_weighted) AS comp_sum,
    count(*) FILTER (sub_exposure_weighted > 0) AS n_sub, count(*) FILTER (comp_exposure_weighted > 0) AS n_comp FROM exposed GROUP BY 1"""
EXPOSED_COLS = "PRODUCT_ID:b n_rows:b sub_sum:4 comp_sum:4 n_sub:b n_comp:b"


def _exposed_by_product(exposed: DataFrame) -> DataFrame:
    sub, comp = F.col("sub_exposure_weighted"), F.col("comp_exposure_weighted")
    return exposed.groupBy(PRODUCT).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(sub).alias("sub_sum"), F.sum(comp).alias("comp_sum"),
        F.count_if(sub > 0).alias("n_sub"), F.count_if(comp > 0).alias("n_comp"),
    )


@query(
    "catalog_panel", "PRODUCT_ID:b n_rows:b units:4 n_promoted:b SUB_COMMODITY_DESC",
    "SELECT PRODUCT_ID, count(*) AS n_rows, sum(units_sold) AS units, sum(promo_any) AS n_promoted, SUB_COMMODITY_DESC FROM panel GROUP BY PRODUCT_ID, SUB_COMMODITY_DESC",
    catalog="part",
)
def catalog_panel(b):
    """The dense panel of a product per part, by product."""
    return b.panel.groupBy(PRODUCT, "SUB_COMMODITY_DESC").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("units_sold").alias("units"), F.sum("promo_any").alias("n_promoted")
    )


@query("catalog_complements", "src:b dst:b w:6", "SELECT * FROM comp_edges", catalog="part")
def catalog_complements(b):
    return b.complements_once


@query("catalog_substitutes", "src:b dst:b w:6", "SELECT * FROM sub_edges", catalog="part")
def catalog_substitutes(b):
    return b.substitutes


@query("catalog_exposure", EXPOSED_COLS, PER_PRODUCT, catalog="part")
def catalog_exposure(b):
    return _exposed_by_product(exposure.add_exposures(b.panel, b.edges))


@query("catalog_exposure_blocks", EXPOSED_COLS, PER_PRODUCT, catalog="part")
def catalog_exposure_blocks(b):
    """Through the shuffled grid of edge blocks."""
    return _exposed_by_product(exposure.add_exposures(b.panel, b.edges, block_rows=2000))


@query("catalog_walks", "walk_id:b walk", f"SELECT walk_id, walk FROM ({_long_walk_sql(2, 20)})", catalog="part")
def catalog_walks(b):
    out = walks.unbiased_walks(b.complements, b.nodes, num_walks=2, walk_length=20)
    return out.select("walk_id", F.array_join("walk", ",").alias("walk"))


@query("catalog_folds", "PRODUCT_ID:b n_rows:b fold:i", "SELECT * FROM folds", catalog="part")
def catalog_folds(b):
    return covariates.group_folds(b.panel, 5)


@query("catalog_dml", EFFECT_COLS, sql.dml_three("res_promo", EDGE), catalog="part")
def catalog_dml(b):
    options = {"nuisance": CELL_MEAN, "min_demand_filter": None, "with_cate": False}
    return dml.run_graph_dml(b.panel, b.edges, **options).effects


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(q.__call__) for name, q in QUERIES.items()}


def as_sql() -> dict[str, str]:
    return {name: text for name, q in QUERIES.items() if (text := q.sql()) is not None}
