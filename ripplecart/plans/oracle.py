"""The study's tables and steps once more as ANSI SQL, to check the Spark results against.

``CTES`` maps a name to its SELECT; a query's SQL is put together from the names its text uses.
"""

from __future__ import annotations

import re

KEYS = "STORE_ID, PRODUCT_ID, WEEK_NO"


def u(*parts: str) -> str:
    """Hash uniform of SQL expressions joined by '|'."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


CELL_KEY = "STORE_ID || '|' || PRODUCT_ID || '|' || WEEK_NO"
CELL_PARTS = ("STORE_ID", "PRODUCT_ID", "WEEK_NO")

CTES = {
    "product_map": """
        SELECT p_partkey, CAST(substr(p_brand, 7) AS BIGINT) AS b, p_type,
               CAST(substr(p_brand, 7) AS BIGINT) * 10 + dense_rank() OVER (ORDER BY p_type) AS PRODUCT_ID
        FROM part""",
    "product": """
        SELECT DISTINCT PRODUCT_ID, p_type AS DEPARTMENT, p_type || '-C' || (b % 2) AS COMMODITY_DESC,
               p_type || '-S' || (b % 4) AS SUB_COMMODITY_DESC,
               CASE WHEN b <= 12 THEN 'National' ELSE 'Private' END AS BRAND
        FROM product_map""",
    "tx": """
        SELECT o_custkey AS household_key, l_orderkey AS BASKET_ID,
               CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) + 1 AS INTEGER) AS DAY,
               CAST(floor(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) / 28.0) AS INTEGER) + 1 AS WEEK_NO,
               PRODUCT_ID, CAST(n_regionkey AS BIGINT) AS STORE_ID, l_quantity AS QUANTITY,
               l_extendedprice * (1 - l_discount) AS SALES_VALUE, -l_extendedprice * l_discount AS RETAIL_DISC,
               CASE WHEN l_returnflag = 'R' THEN -l_tax ELSE 0.0 END AS COUPON_DISC,
               CASE WHEN l_linestatus = 'F' THEN -l_tax / 2 ELSE 0.0 END AS COUPON_MATCH_DISC
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN product_map ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "cells": f"""
        SELECT {KEYS}, sum(QUANTITY) AS units_sold, sum(SALES_VALUE) AS sales_value,
               sum(RETAIL_DISC) AS retail_disc_total,
               coalesce(abs(sum(RETAIL_DISC)) / nullif(sum(SALES_VALUE) + abs(sum(RETAIL_DISC)), 0), 0) AS discount_rate
        FROM tx GROUP BY {KEYS}""",
    "week_range": "SELECT PRODUCT_ID, min(WEEK_NO) AS week_min, max(WEEK_NO) AS week_max FROM cells GROUP BY 1",
    "pstores": "SELECT DISTINCT PRODUCT_ID, STORE_ID FROM cells",
    "idx": """
        SELECT STORE_ID, PRODUCT_ID, CAST(unnest(range(week_min, week_max + 1)) AS INTEGER) AS WEEK_NO
        FROM pstores JOIN week_range USING (PRODUCT_ID)""",
    "causal_u": f"""
        SELECT {KEYS}, {u("'d'", CELL_KEY)} AS ud, {u("'m'", CELL_KEY)} AS um
        FROM idx WHERE {u("'row'", CELL_KEY)} < 0.5""",
    "causal": f"""
        SELECT {KEYS}, CASE WHEN ud < 0.02 THEN NULL WHEN ud < 0.12 THEN ' A ' WHEN ud < 0.20 THEN '9' ELSE '0' END AS display,
               CASE WHEN um < 0.10 THEN 'D' ELSE ' 0' END AS mailer
        FROM causal_u""",
    "flags": f"""
        SELECT {KEYS}, CASE WHEN trim(display) = '0' THEN 0 ELSE 1 END AS display,
               CASE WHEN trim(mailer) = '0' THEN 0 ELSE 1 END AS mailer,
               CASE WHEN trim(display) = '0' AND trim(mailer) = '0' THEN 0 ELSE 1 END AS promo_any
        FROM causal""",
    "panel": f"""
        SELECT {KEYS}, coalesce(units_sold, 0) AS units_sold, coalesce(sales_value, 0) AS sales_value,
               coalesce(retail_disc_total, 0) AS retail_disc_total, coalesce(discount_rate, 0) AS discount_rate,
               CASE WHEN coalesce(units_sold, 0) > 0 THEN 1 ELSE 0 END AS sold_any, coalesce(display, 0) AS display,
               coalesce(mailer, 0) AS mailer, coalesce(promo_any, 0) AS promo_any,
               DEPARTMENT, COMMODITY_DESC, SUB_COMMODITY_DESC, BRAND
        FROM idx LEFT JOIN cells USING ({KEYS}) LEFT JOIN flags USING ({KEYS}) LEFT JOIN product USING (PRODUCT_ID)""",
    "emb": """
        SELECT vec_id AS PRODUCT_ID, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE vec_id IN (SELECT PRODUCT_ID FROM product)""",
    "items": "SELECT DISTINCT BASKET_ID, PRODUCT_ID FROM tx",
    "marginal": "SELECT PRODUCT_ID, count(*) AS n_baskets FROM items GROUP BY 1",
    "pairs": """
        SELECT x.PRODUCT_ID AS a, y.PRODUCT_ID AS b, count(*) AS n_ab
        FROM items x JOIN items y ON x.BASKET_ID = y.BASKET_ID AND x.PRODUCT_ID < y.PRODUCT_ID
        GROUP BY 1, 2 HAVING count(*) >= 10""",
    "pmi": """
        SELECT a, b, n_ab, ln(CAST(n_ab AS DOUBLE) * (SELECT count(DISTINCT BASKET_ID) FROM items)
                              / (ma.n_baskets * mb.n_baskets)) AS pmi
        FROM pairs JOIN marginal ma ON a = ma.PRODUCT_ID JOIN marginal mb ON b = mb.PRODUCT_ID""",
    "ppmi": "SELECT a, b, n_ab, pmi / (SELECT max(pmi) FROM pmi) AS w FROM pmi WHERE pmi > 0",
    "comp_edges": "SELECT a AS src, b AS dst, w FROM ppmi UNION ALL SELECT b, a, w FROM ppmi",
    "sub_scored": """
        SELECT p.PRODUCT_ID AS src, q.PRODUCT_ID AS dst,
               CASE WHEN e.v IS NULL OR f.v IS NULL THEN 1.0 ELSE greatest(list_cosine_similarity(e.v, f.v), 0) END AS w
        FROM product p JOIN product q ON p.SUB_COMMODITY_DESC = q.SUB_COMMODITY_DESC AND p.PRODUCT_ID <> q.PRODUCT_ID
        LEFT JOIN emb e ON e.PRODUCT_ID = p.PRODUCT_ID LEFT JOIN emb f ON f.PRODUCT_ID = q.PRODUCT_ID""",
    "sub_ranked": "SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM sub_scored",
    "sub_edges": """
        SELECT src, dst, max(w) AS w FROM (
          SELECT src, dst, w FROM sub_ranked WHERE r <= 50 AND w > 0
          UNION ALL SELECT dst, src, w FROM sub_ranked WHERE r <= 50 AND w > 0) GROUP BY 1, 2""",
    "sub_edges_3": """
        SELECT src, dst, max(w) AS w FROM (
          SELECT src, dst, w FROM sub_ranked WHERE r <= 3 AND w > 0
          UNION ALL SELECT dst, src, w FROM sub_ranked WHERE r <= 3 AND w > 0) GROUP BY 1, 2""",
    "sub_plain_ranked": "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM sub_scored",
    "sub_plain_2": """
        SELECT src, dst, 1.0 AS w FROM sub_plain_ranked WHERE r <= 2
        UNION SELECT dst, src, 1.0 FROM sub_plain_ranked WHERE r <= 2""",
    "edges": "SELECT 'sub' AS graph, src, dst, w FROM sub_edges UNION ALL SELECT 'comp', src, dst, w FROM comp_edges",
    "nodes": "SELECT DISTINCT PRODUCT_ID FROM tx",
    "featured": """
        SELECT p.*, coalesce(st, 0) AS n_treated_substitutes, coalesce(st / sn, 0) AS frac_treated_substitutes,
               coalesce(su / sn, 0) AS avg_units_substitutes, coalesce(ct, 0) AS n_treated_complements,
               coalesce(ct / cn, 0) AS frac_treated_complements, coalesce(cu / cn, 0) AS avg_units_complements
        FROM panel p LEFT JOIN (
          SELECT STORE_ID, WEEK_NO, src AS PRODUCT_ID,
                 sum(promo_any) FILTER (graph = 'sub') AS st, sum(units_sold) FILTER (graph = 'sub') AS su,
                 nullif(count(*) FILTER (graph = 'sub'), 0) AS sn, sum(promo_any) FILTER (graph = 'comp') AS ct,
                 sum(units_sold) FILTER (graph = 'comp') AS cu, nullif(count(*) FILTER (graph = 'comp'), 0) AS cn
          FROM panel JOIN edges ON dst = PRODUCT_ID GROUP BY 1, 2, 3) s USING (STORE_ID, PRODUCT_ID, WEEK_NO)""",
    "folds": """
        SELECT PRODUCT_ID, n_rows, fold FROM (
          WITH RECURSIVE sized AS MATERIALIZED (
            SELECT PRODUCT_ID, n_rows, row_number() OVER (ORDER BY n_rows DESC, PRODUCT_ID) AS r
            FROM (SELECT PRODUCT_ID, count(*) AS n_rows FROM panel GROUP BY 1)
          ), dealt(r, PRODUCT_ID, n_rows, fold, loads) AS (
            SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 0, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
            SELECT s.r, s.PRODUCT_ID, s.n_rows, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
                   list_transform(range(1, 6), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN s.n_rows ELSE 0 END)
            FROM dealt JOIN sized s ON s.r = dealt.r + 1)
          SELECT * FROM dealt WHERE r > 0)""",
    "permutable": f"""
        SELECT STORE_ID, PRODUCT_ID, WEEK_NO, units_sold, promo_any, count(*) OVER () AS n,
               row_number() OVER (ORDER BY promo_any NULLS FIRST, {u("42", "'rank'", *CELL_PARTS)}, STORE_ID, PRODUCT_ID, WEEK_NO) - 1 AS k FROM panel""",
    "cate_groups": """
        SELECT DEPARTMENT, avg(direct_cate) AS direct_mean, stddev_samp(direct_cate) AS direct_std,
               avg(sub_spillover_cate) AS sub_spill_mean, stddev_samp(sub_spillover_cate) AS sub_spill_std,
               avg(comp_spillover_cate) AS comp_spill_mean, stddev_samp(comp_spillover_cate) AS comp_spill_std,
               count(direct_cate) AS n_obs FROM cate GROUP BY 1""",
    "sims": """
        SELECT l_orderkey AS sim_id,
               CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'sub_spillover' ELSE 'comp_spillover' END AS effect,
               CAST(0.05 AS DOUBLE) AS true_value, l_discount AS estimate, l_discount - l_tax AS ci_lower,
               l_discount + l_tax AS ci_upper FROM lineitem""",
    "priced": "SELECT *, SALES_VALUE / QUANTITY AS unit_price FROM tx WHERE QUANTITY > 0",
    "campaign_table": "SELECT o_custkey AS household_key, CAST(o_orderkey % 30 AS INTEGER) AS CAMPAIGN FROM orders",
    "redemptions": """
        SELECT o_custkey AS household_key,
               CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) + 1 AS INTEGER) AS DAY,
               o_orderkey % 500 AS COUPON_UPC FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "campaigns": """
        SELECT CAST(o_orderkey % 30 AS INTEGER) AS CAMPAIGN,
               CAST(min(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)) + 1 AS INTEGER) AS START_DAY,
               CAST(max(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)) + 1 AS INTEGER) AS END_DAY FROM orders GROUP BY 1""",
    "coupons": "SELECT DISTINCT COUPON_UPC FROM redemptions",
    "demographics": "SELECT c_custkey AS household_key, c_mktsegment AS INCOME_DESC FROM customer",
    "transitions": """
        SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS prob,
               sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY src) AS cum
        FROM comp_edges""",
    "store_codes": "SELECT STORE_ID, row_number() OVER (ORDER BY STORE_ID) - 1.0 AS code FROM (SELECT DISTINCT STORE_ID FROM panel)",
}


def exposures(treatment: str = "promo_any", weight: str = "w", edges: str = "edges", panel: str = "panel") -> str:
    """Panel rows with the four exposure columns."""
    return f"""
        SELECT p.*, coalesce(sn / sd, 0) AS sub_exposure_weighted, coalesce(sn, 0) AS sub_exposure_sum,
               coalesce(cn / cd, 0) AS comp_exposure_weighted, coalesce(cn, 0) AS comp_exposure_sum
        FROM {panel} p LEFT JOIN (
          SELECT STORE_ID, WEEK_NO, src AS PRODUCT_ID,
                 sum({weight} * {treatment}) FILTER (graph = 'sub') AS sn, sum({weight}) FILTER (graph = 'sub') AS sd,
                 sum({weight} * {treatment}) FILTER (graph = 'comp') AS cn, sum({weight}) FILTER (graph = 'comp') AS cd
          FROM {panel} JOIN {edges} ON dst = PRODUCT_ID GROUP BY 1, 2, 3) s USING (STORE_ID, PRODUCT_ID, WEEK_NO)"""


CTES["exposed"] = exposures()
CTES["exposed_discount"] = exposures("discount_rate")


def frame(source: str, treatment: str) -> str:
    return f"""
        SELECT {KEYS}, DEPARTMENT, fold, ln(1 + units_sold) AS y, CAST({treatment} AS DOUBLE) AS t0,
               sub_exposure_weighted AS t1, comp_exposure_weighted AS t2
        FROM {source} JOIN folds USING (PRODUCT_ID)"""


CTES["frame_promo"] = frame("exposed", "promo_any")
CTES["frame_disc"] = frame("exposed_discount", "discount_rate")


def residuals(source: str) -> str:
    """Out-of-fold department-week means subtracted from y and the treatments."""
    cols = ("y", "t0", "t1", "t2")
    sums = lambda tag: ", ".join(f"sum({c}) AS {c}_{tag}" for c in cols)
    hat = lambda c: (
        f"{c} - CASE WHEN n_c > n_cf THEN ({c}_c - {c}_cf) / (n_c - n_cf) ELSE ({c}_g - {c}_f) / (n_g - n_f) END AS {c}_res"
    )
    return f"""
        SELECT f.*, {", ".join(hat(c) for c in cols)} FROM {source} f
        JOIN (SELECT DEPARTMENT, WEEK_NO, fold, count(*) AS n_cf, {sums("cf")} FROM {source} GROUP BY 1, 2, 3) a
          USING (DEPARTMENT, WEEK_NO, fold)
        JOIN (SELECT DEPARTMENT, WEEK_NO, count(*) AS n_c, {sums("c")} FROM {source} GROUP BY 1, 2) b USING (DEPARTMENT, WEEK_NO)
        JOIN (SELECT fold, count(*) AS n_f, {sums("f")} FROM {source} GROUP BY 1) c USING (fold)
        CROSS JOIN (SELECT count(*) AS n_g, {sums("g")} FROM {source}) d"""


def noise(part: str) -> str:
    return u("42", "'noise'", *CELL_PARTS, f"'{part}'")


CTES["moments"] = """
    SELECT avg(code) AS cm, stddev_pop(code) AS cs, avg(WEEK_NO) AS wm, stddev_pop(WEEK_NO) AS wp, stddev_samp(WEEK_NO) AS ws
    FROM panel JOIN store_codes USING (STORE_ID)"""
CTES["assigned"] = f"""
    SELECT p.* EXCLUDE (promo_any), code, CASE WHEN {u("42", "'assign'", *CELL_PARTS)} <
      1 / (1 + exp(-0.5 * ((code - cm) / (cs + 1e-8) + (WEEK_NO - wm) / (ws + 1e-8)))) THEN 1 ELSE 0 END AS promo_any
    FROM panel p JOIN store_codes USING (STORE_ID) CROSS JOIN moments"""
CTES["exposed_assigned"] = exposures(panel="assigned")
CTES["frame_made"] = f"""
    SELECT {KEYS}, DEPARTMENT, fold, CAST(promo_any AS DOUBLE) AS t0, sub_exposure_weighted AS t1, comp_exposure_weighted AS t2,
      greatest(0, 1.5 + 0.1 * promo_any - 0.05 * sub_exposure_weighted + 0.03 * comp_exposure_weighted
        + 0.5 * (code - cm) / (cs + 1e-8) + 0.3 * (WEEK_NO - wm) / (wp + 1e-8)
        + 0.5 * sqrt(-2 * ln(1 - {noise("a")})) * cos(6.283185307179586 * {noise("b")})) AS y
    FROM exposed_assigned JOIN folds USING (PRODUCT_ID) CROSS JOIN moments"""
CTES["res_made"] = residuals("frame_made")
CTES["exposed_binary"] = exposures(weight="1.0")
CTES["frame_bin"] = frame("exposed_binary", "promo_any")
CTES["res_bin"] = residuals("frame_bin")
CTES["res_promo"] = residuals("frame_promo")
CTES["res_disc"] = residuals("frame_disc")
Z95 = "1.959963984540054"


def dml_three(res: str, model: str) -> str:
    """Three-treatment regression by the closed-form 3x3 inverse, two-way clustered errors."""
    g = {(i, j): f"g{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    inv = {
        (0, 0): f"({g[1, 1]}*{g[2, 2]}-{g[1, 2]}*{g[1, 2]})/det",
        (0, 1): f"({g[0, 2]}*{g[1, 2]}-{g[0, 1]}*{g[2, 2]})/det",
        (0, 2): f"({g[0, 1]}*{g[1, 2]}-{g[0, 2]}*{g[1, 1]})/det",
        (1, 1): f"({g[0, 0]}*{g[2, 2]}-{g[0, 2]}*{g[0, 2]})/det",
        (1, 2): f"({g[0, 1]}*{g[0, 2]}-{g[0, 0]}*{g[1, 2]})/det",
        (2, 2): f"({g[0, 0]}*{g[1, 1]}-{g[0, 1]}*{g[0, 1]})/det",
    }
    at = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    grams = ", ".join(f"sum(t{i}_res*t{j}_res) AS g{i}{j}" for i, j in inv)
    rhs = ", ".join(f"sum(t{i}_res*y_res) AS b{i}" for i in range(3))
    det = (
        f"{g[0, 0]}*({g[1, 1]}*{g[2, 2]}-{g[1, 2]}*{g[1, 2]}) - {g[0, 1]}*({g[0, 1]}*{g[2, 2]}-{g[1, 2]}*{g[0, 2]})"
        f" + {g[0, 2]}*({g[0, 1]}*{g[1, 2]}-{g[1, 1]}*{g[0, 2]})"
    )
    beta = ", ".join(f"{at(j, 0)}*b0+{at(j, 1)}*b1+{at(j, 2)}*b2 AS beta{j}" for j in range(3))
    infl = ", ".join(
        f"(y_res-beta0*t0_res-beta1*t1_res-beta2*t2_res)*({at(j, 0)}*t0_res+{at(j, 1)}*t1_res+{at(j, 2)}*t2_res) AS u{j}"
        for j in range(3)
    )
    su = ", ".join(f"sum(u{j}) AS u{j}" for j in range(3))
    sq = ", ".join(f"sum(u{j}*u{j}) AS v{j}" for j in range(3))
    by = lambda c: f"SELECT count(*) AS g, {sq} FROM (SELECT {c}, {su} FROM infl GROUP BY {c})"
    out = " UNION ALL ".join(
        f"""SELECT '{model}' AS model, '{name}' AS effect, beta{j} AS ATE,
            sqrt((p.g/(p.g-1.0)*p.v{j} + s.g/(s.g-1.0)*s.v{j} - ps.g/(ps.g-1.0)*ps.v{j})*(n-1.0)/(n-3.0)) AS se, n AS n_obs
            FROM fit, ({by("PRODUCT_ID")}) p, ({by("STORE_ID")}) s, ({by("PRODUCT_ID, STORE_ID")}) ps"""
        for j, name in enumerate(("direct", "sub_spillover", "comp_spillover"))
    )
    return f"""
        SELECT model, effect, ATE, se, ATE - {Z95} * se AS CI_lower, ATE + {Z95} * se AS CI_upper, n_obs FROM (
          WITH mom AS (SELECT count(*) AS n, {grams}, {rhs} FROM {res}),
          d AS (SELECT *, {det} AS det FROM mom),
          inv AS (SELECT *, {", ".join(f"{e} AS i{i}{j}" for (i, j), e in inv.items())} FROM d),
          fit AS (SELECT *, {beta} FROM inv),
          infl AS (SELECT PRODUCT_ID, STORE_ID, {infl} FROM {res} CROSS JOIN fit)
          {out})"""


def dml_two(res: str, other: str, model: str) -> str:
    """Direct effect and one channel; the switched-off channel is 0 but still counts as a regressor."""
    by = lambda c: f"SELECT count(*) AS g, sum(u0*u0) AS v0, sum(u1*u1) AS v1 FROM (SELECT {c}, sum(u0) AS u0, sum(u1) AS u1 FROM infl GROUP BY {c})"
    kept = {"t1": "sub_spillover", "t2": "comp_spillover"}
    off = kept["t2" if other == "t1" else "t1"]
    se = lambda j: (
        f"sqrt((p.g/(p.g-1.0)*p.v{j} + s.g/(s.g-1.0)*s.v{j} - ps.g/(ps.g-1.0)*ps.v{j})*(n-1.0)/(n-3.0))"
    )
    tables = f"FROM fit, ({by('PRODUCT_ID')}) p, ({by('STORE_ID')}) s, ({by('PRODUCT_ID, STORE_ID')}) ps"
    return f"""
        SELECT model, effect, ATE, se, ATE - {Z95} * se AS CI_lower, ATE + {Z95} * se AS CI_upper, n_obs FROM (
          WITH mom AS (SELECT count(*) AS n, sum(t0_res*t0_res) AS g00, sum(t0_res*{other}_res) AS g01,
                       sum({other}_res*{other}_res) AS g11, sum(t0_res*y_res) AS b0, sum({other}_res*y_res) AS b1 FROM {res}),
          inv AS (SELECT *, g11/(g00*g11-g01*g01) AS i00, -g01/(g00*g11-g01*g01) AS i01, g00/(g00*g11-g01*g01) AS i11 FROM mom),
          fit AS (SELECT *, i00*b0+i01*b1 AS beta0, i01*b0+i11*b1 AS beta1 FROM inv),
          infl AS (SELECT PRODUCT_ID, STORE_ID, (y_res-beta0*t0_res-beta1*{other}_res)*(i00*t0_res+i01*{other}_res) AS u0,
                   (y_res-beta0*t0_res-beta1*{other}_res)*(i01*t0_res+i11*{other}_res) AS u1 FROM {res} CROSS JOIN fit)
          SELECT '{model}' AS model, 'direct' AS effect, beta0 AS ATE, {se(0)} AS se, n AS n_obs {tables} UNION ALL
          SELECT '{model}', '{kept[other]}', beta1, {se(1)}, n {tables} UNION ALL SELECT '{model}', '{off}', 0, 0, n FROM fit)"""


def dml_one(res: str) -> str:
    """Single-treatment regression with two-way clustered errors."""
    by = lambda c: f"SELECT count(*) AS g, sum(s*s) AS v FROM (SELECT {c}, sum(s) AS s FROM sc GROUP BY {c})"
    return f"""
        SELECT 'dml_direct' AS model, 'direct' AS effect, b AS ATE, se, b - {Z95} * se AS CI_lower,
               b + {Z95} * se AS CI_upper, n AS n_obs FROM (
          WITH fit AS (SELECT count(*) AS n, sum(t0_res*t0_res) AS g, sum(t0_res*y_res)/sum(t0_res*t0_res) AS b FROM {res}),
          sc AS (SELECT PRODUCT_ID, STORE_ID, t0_res*(y_res-b*t0_res) AS s FROM {res} CROSS JOIN fit)
          SELECT b, n, sqrt(greatest(0, p.g/(p.g-1.0)*p.v + s.g/(s.g-1.0)*s.v - ps.g/(ps.g-1.0)*ps.v))/fit.g AS se
          FROM fit, ({by("PRODUCT_ID")}) p, ({by("STORE_ID")}) s, ({by("PRODUCT_ID, STORE_ID")}) ps)"""


CODES = ", ".join(
    f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_code" for c in ("DEPARTMENT", "COMMODITY_DESC", "SUB_COMMODITY_DESC", "BRAND")
)
CTES["product_codes"] = f"SELECT PRODUCT_ID, {CODES} FROM product"
REGRESSORS = ("1", "STORE_ID", "WEEK_NO", "DEPARTMENT_code", "COMMODITY_DESC_code", "SUB_COMMODITY_DESC_code", "BRAND_code")


def partialled_out(
    source: str, targets: tuple[str, ...], keep: str, train: str = "true", regressors: tuple[str, ...] = REGRESSORS
) -> str:
    """Targets minus their least-squares fit on the regressors: columns y0, y1, ... next to ``keep``.

    The regressors are removed one after the other, each made orthogonal to the earlier ones over
    the rows where ``train`` holds and subtracted everywhere.
    """
    xs = [f"x{i}" for i in range(len(regressors))]
    ys = [f"y{i}" for i in range(len(targets))]
    first = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip((*regressors, *targets), xs + ys, strict=True))
    text = f"SELECT {keep}, {first} FROM {source} JOIN product_codes USING (PRODUCT_ID)"
    for i, q in enumerate(xs):
        fit = lambda c, q=q: f"sum({c}*{q}) FILTER ({train}) OVER () / sum({q}*{q}) FILTER ({train}) OVER () * {q}"
        text = f"SELECT {keep}, {', '.join(f'{c} - {fit(c)} AS {c}' for c in xs[i + 1:] + ys)} FROM ({text})"
    return text


def ols_with_controls() -> str:
    """Coefficient of the treatment, HC1 error and R2 of OLS on treatment and REGRESSORS."""
    k = len(REGRESSORS) + 1
    return f"""
        SELECT 'ols_no_graph' AS model, 'direct' AS effect, b AS ATE, se, b - {Z95} * se AS CI_lower, b + {Z95} * se AS CI_upper,
               n AS n_obs, 1 - sse / (SELECT count(*) * var_pop(units_sold) FROM panel) AS r_squared FROM (
          WITH po AS ({partialled_out("panel", ("units_sold", "promo_any"), "PRODUCT_ID")}),
          fit AS (SELECT sum(y0*y1)/sum(y1*y1) AS b FROM po)
          SELECT b, count(*) AS n, sum(pow(y0-b*y1, 2)) AS sse,
                 sqrt(sum(pow((y0-b*y1)*y1, 2)) * count(*) / (count(*) - {k})) / sum(y1*y1) AS se FROM po CROSS JOIN fit GROUP BY b)"""


CTES["row_frame"] = f"""
    SELECT * EXCLUDE (display, mailer), CAST(floor({u("42", "'fold'", *CELL_PARTS)} * 5) AS INTEGER) AS fold, units_sold AS y,
           CAST(promo_any AS DOUBLE) AS t0, 0.0 AS t1, 0.0 AS t2 FROM featured"""
CTES["row_res"] = residuals("row_frame")
FEATURES = tuple(f"{a}_{b}" for b in ("substitutes", "complements") for a in ("n_treated", "frac_treated", "avg_units"))


def dml_with_slopes(model: str, controls: tuple[str, ...]) -> str:
    """Mean effect of a single treatment whose effect is linear in centred controls, HC1 error.

    The slopes' regressors are partialled out of the outcome and of the treatment; what is left of
    the treatment gives the coefficient at the mean of the controls.
    """
    slopes = tuple(f"t0_res * ({c} - avg({c}) OVER ())" for c in controls)
    return f"""
        SELECT '{model}' AS model, 'direct' AS effect, b AS ATE, se, b - {Z95} * se AS CI_lower, b + {Z95} * se AS CI_upper, n AS n_obs FROM (
          WITH po AS ({partialled_out("row_res", ("y_res", "t0_res"), "PRODUCT_ID", regressors=slopes)}),
          fit AS (SELECT sum(y0*y1)/sum(y1*y1) AS b FROM po)
          SELECT b, count(*) AS n, sqrt(sum(pow((y0-b*y1)*y1, 2)) * count(*) / (count(*) - {len(controls) + 1})) / sum(y1*y1) AS se
          FROM po CROSS JOIN fit GROUP BY b)"""


CTES["res_linear"] = " UNION ALL ".join(
    f"""SELECT PRODUCT_ID, STORE_ID, y0 AS y_res, y1 AS t0_res, y2 AS t1_res, y3 AS t2_res
        FROM ({partialled_out("frame_promo", ("y", "t0", "t1", "t2"), "PRODUCT_ID, STORE_ID, fold", f"fold <> {f}")}) WHERE fold = {f}"""
    for f in range(5)
)


def _cate_tables() -> dict[str, str]:
    """Per-row effects of the three-treatment model that are linear in the covariates.

    The fit is taken by successive orthogonalisation. Its value at 21 added points (each treatment alone, at the origin and
    at a unit of each covariate), which take no part in the fit, gives the coefficients.
    """
    w = REGRESSORS[1:]
    names = [c.lower() for c in w]
    points = [
        f"SELECT false AS train, 0.0 AS y_res, {', '.join(f'{float(i == j)} AS t{i}_res' for i in range(3))}, "
        f"{', '.join(f'{float(k == n)} AS {n}' for n in names)}, {j} AS j, '{k}' AS k"
        for j in range(3) for k in ("origin", *names)
    ]
    rows = f"SELECT true AS train, y_res, t0_res, t1_res, t2_res, {', '.join(f'CAST({c} AS DOUBLE) AS {n}' for c, n in zip(w, names, strict=True))}, -1 AS j, '' AS k"
    source = f"{rows} FROM res_promo JOIN product_codes USING (PRODUCT_ID) UNION ALL {' UNION ALL '.join(points)}"
    terms = [f"t{i}_res" if n is None else f"t{i}_res * {n}" for i in range(3) for n in (None, *names)]
    xs = [f"x{i}" for i in range(len(terms))]
    text = f"SELECT train, j, k, y_res AS y, {', '.join(f'{t} AS {x}' for t, x in zip(terms, xs, strict=True))} FROM ({source})"
    for i, q in enumerate(xs):
        fit = lambda c, q=q: f"sum({c}*{q}) FILTER (train) OVER () / sum({q}*{q}) FILTER (train) OVER () * {q}"
        text = f"SELECT train, j, k, {', '.join(f'{c} - {fit(c)} AS {c}' for c in [*xs[i + 1:], 'y'])} FROM ({text})"
    value = lambda j, k: f"max(-y) FILTER (j = {j} AND k = '{k}')"
    coefficients = ", ".join(
        [f"{value(j, 'origin')} AS c{j}" for j in range(3)] + [f"{value(j, n)} - {value(j, 'origin')} AS c{j}_{n}" for j in range(3) for n in names]
    )
    effects = ", ".join(
        f"c{j} + {' + '.join(f'c{j}_{n} * {c}' for c, n in zip(w, names, strict=True))} AS {e}_cate"
        for j, e in enumerate(("direct", "sub_spillover", "comp_spillover"))
    )
    return {
        "cate_fit": f"SELECT {coefficients} FROM ({text}) WHERE NOT train",
        "cate": f"SELECT p.*, {effects} FROM panel p JOIN product_codes USING (PRODUCT_ID) CROSS JOIN cate_fit",
    }


CTES |= _cate_tables()


#: The same steps on a catalog with a product per part: baskets are what a store ships in a day, two common ones make a pair.
CATALOG = {
    **CTES,
    "product_map": "SELECT p_partkey, CAST(substr(p_brand, 7) AS BIGINT) AS b, p_type, p_partkey AS PRODUCT_ID, p_size % 5 AS s FROM part",
    "product": """
        SELECT DISTINCT PRODUCT_ID, p_type AS DEPARTMENT, p_type || '-C' || b AS COMMODITY_DESC, p_type || '-C' || b || '-S' || s AS SUB_COMMODITY_DESC,
               CASE WHEN b <= 12 THEN 'National' ELSE 'Private' END AS BRAND
        FROM product_map""",
    "tx": CTES["tx"].replace("l_orderkey AS BASKET_ID", "(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) + 1) * 100 + n_regionkey AS BASKET_ID"),
    "pairs": CTES["pairs"].replace("count(*) >= 10", "count(*) >= 2"),
}


def with_ctes(body: str, ctes: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every CTE it needs, dependencies first."""
    order: list[str] = []
    ctes = CTES if ctes is None else ctes

    def need(text: str) -> None:
        for name, select in ctes.items():
            if name not in order and select != text and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need(select)
                order.append(name)

    need(body)
    text = ",\n".join(f"{n} AS ({ctes[n].strip()})" for n in order)
    return f"WITH {text}\n{body}" if text else body
