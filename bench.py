"""Wall-clock bench of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and forces full evaluation with the ``noop`` sink (all
rows computed, nothing collected to the driver). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabfold.plans.catalog import QUERIES  # noqa: E402
from tabfold.session import build_session  # noqa: E402

HEADLINE = [
    "e12_target_encode_smoothed",
    "e1_label_encode_fit",
    "e13_woe_share_form",
    "p2_describe_numeric",
    "p19_crosstab_margins",
    "p25_corr_matrix",
    "c5_forward_fill",
    "c7_fill_group_mode",
    "f12_boxcox_lambda_apply",
    "f15_pairwise_group_means",
    "f17_percent_rank_in_group",
    "r10_stratified_kfold",
    "r12_repeated_cv_plan",
    "x1_ranksum_z",
    "v7_v9_cutoff_sweep",
    "v11_auc_exact_ties",
    "b3_harmonic_blend",
    "b16_tune_blend_weights",
    "f22_knn_distances",
    "m15_cv_oof_scores",
    "z6_score_blend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    # warm the JVM and the parquet footers once (not timed)
    QUERIES["p1_shape"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
