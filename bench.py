"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (folder of the tables, default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed once after a small warm-up of the JVM and of the Python workers, its rows discarded.
"""

from __future__ import annotations

import json
import os
import time

from tidepanel.session import local_session
from workloads import registered

HEADLINES = (
    "flagship_portfolio", "ts_rolling_basic", "ts_rolling_position", "indicators_recursive", "alpha158", "tech39",
    "custom_factors", "canonical_daily", "intraday_day_features", "intraday_variants_outer_join",
    "intraday_user_aggregates", "asof_macro_columns", "factor_graph_daily_macro", "cs_rank", "cs_normalize_rank",
    "winsorize_mad", "augmented_features", "label_mad_clip", "loss_target_drop_clip_rank", "sliding_sequences",
    "portfolio_industry_cap", "rank_ic", "strategy_reselection", "loss_pairwise_top_fraction", "correlation_edges",
    "similarity_knn", "sink_partitioned_write_modes")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench", "16g")
    queries = registered()

    def timed(name: str, where: str) -> float:
        start = time.time()
        queries[name].run(spark, where).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("indicators_recursive", "cs_rank"):
            timed(name, small)
    seconds = {name: timed(name, folder) for name in HEADLINES}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
