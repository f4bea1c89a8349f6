"""Count shuffles, join strategies, windows and Python operators in the
physical plans of the headline queries (the README's plan census)."""

from __future__ import annotations

import os
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import bench  # noqa: E402
from tabfold.plans.catalog import QUERIES  # noqa: E402
from tabfold.session import build_session  # noqa: E402

PATTERNS = {
    "shuffles": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
    "broadcast joins": r"BroadcastHashJoin",
    "sort-merge joins": r"SortMergeJoin",
    "windows": r"Window \[",
    "python (pandas UDF)": r"ArrowEvalPython|FlatMapCoGroupsInPandas|FlatMapGroupsInPandas|MapInPandas",
    "row-at-a-time python": r"BatchEvalPython",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("local[8]", 16)
    print("| query | " + " | ".join(PATTERNS) + " |")
    print("|---|" + "---|" * len(PATTERNS))
    for n in sys.argv[1:] or bench.HEADLINE:
        plan = QUERIES[n](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        print(f"| {n} | " + " | ".join(str(len(re.findall(p, plan))) for p in PATTERNS.values()) + " |")


if __name__ == "__main__":
    main()
