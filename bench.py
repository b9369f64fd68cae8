"""Time the headline jobs: 25 stores and weekly periods over $BENCH_SF_DIR, on local[$BENCH_CPUS].

Every job is run once, in full, into Spark's no-op sink. Jobs that need the panel or the graphs read
the saved tables, which are themselves timed as ``panel_build`` and ``graph_build``.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ripplecart.functions.distributed import drop_settled
from ripplecart.plans.queries import QUERIES
from ripplecart.plans.session import local_session
from ripplecart.plans.workbench import Workbench

HEADLINE = [
    "tx_cells", "panel_full", "cooccurrence_pairs", "complement_edges", "substitute_edges", "exposure_weighted",
    "exposure_interval", "exposure_binary", "exposure_discount", "spillover_features", "exposure_by_department",
    "walks_unbiased_3", "group_folds", "dml_residuals", "dml_graph_k3", "dml_discount_k3", "ols_baseline",
    "dml_no_graph_constant", "cate_by_department", "top_spillover_products", "covariate_balance", "sample_exact_n",
    "placebo_permutation", "known_effect_outcome", "entity_counts", "price_describe", "price_trim", "promo_coverage",
    "treatment_top30", "treatment_variation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
        bench = Workbench(spark, folder, store="nation", period_days=7)
        spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
        times: dict[str, float] = {}

        def timed(name: str, job) -> None:
            start = time.perf_counter()
            job()
            times[name] = round(time.perf_counter() - start, 3)
            print(f"{name:28s} {times[name]:8.2f}s", flush=True)

        timed("panel_build", lambda: bench.panel.count())
        timed("graph_build", lambda: (bench.edges.count(), bench.nodes.count()))
        for name in asked:
            timed(name, lambda q=QUERIES[name]: q.run(bench).write.format("noop").mode("overwrite").save())
        drop_settled(spark)
        spark.stop()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": Path(folder).name.removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
