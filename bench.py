"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import registry  # noqa: E402
from paneldrift.session import local_session  # noqa: E402

HEADLINE = (
    "two_date_indicators", "smoothed_indicators", "analysis_table", "densify_panel", "share_composition",
    "share_ratio_diff", "evolution_from_shares", "change_metrics", "presence_likelihood", "agreement_flag",
    "contingency", "site_left_join", "null_safe_totals_join", "species_wide", "cross_model_pairs",
    "numeric_profile", "boxplot_stats", "distribution_by_year", "top_n_ties", "mid_ranks",
    "spearman_by_group", "ols_categorical", "ols_pair", "anova_oneway", "kruskal", "dunn_bh",
    "wilcoxon_pairs", "jarque_bera", "lm_diagnostics", "bootstrap_ci", "point_in_polygon", "map_likelihood",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    for name in ("two_date_indicators", "kruskal"):  # start the JVM's compiler and the Python workers
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        begun = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
