"""Physical-plan audit of every registered query.

For each key prints: shuffles (Exchange), broadcasts, Python evaluation nodes,
nested-loop / cartesian joins, single-partition exchanges and whether scans
read a pruned schema. Usage: python scripts/plan_report.py [--sf-dir DIR] [key ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.plans.registry import all_queries  # noqa: E402
from strata.session import build_session  # noqa: E402


def audit(plan: str) -> dict:
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan)),
        "single_partition": plan.count("Exchange SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": len(re.findall(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas)", plan)),
        "nested_loop": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "scans": plan.count("FileScan"),
        "window_group_limit": plan.count("WindowGroupLimit"),
    }


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    reg = all_queries()
    for k in args.keys or sorted(reg):
        try:
            df = reg[k][0](spark, args.sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
            a = audit(plan)
            print(f"{k:28s} " + " ".join(f"{n}={v}" for n, v in a.items()), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} ERROR {type(e).__name__}: {str(e)[:200]}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
