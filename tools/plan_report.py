"""Print a markdown inventory of the physical plans of the library's registered queries.

usage: python tools/plan_report.py [SF_DIR] > PLANS.md
Counts shuffle and broadcast exchanges, joins and aggregates in the
initial (pre-AQE) plan and lists scanned columns per table. The training-data operators run jobs of their own and are not listed.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.catalog import QUERIES  # noqa: E402
from tessera.session import get_session  # noqa: E402


def summarize(plan: str) -> dict:
    lines = plan.splitlines()
    joins = [re.search(r"(\w+Join)\b.*?(Inner|LeftOuter|LeftAnti|LeftSemi|FullOuter|RightOuter)", l) for l in lines]
    scans = []
    for l in lines:
        m = re.search(r"FileScan parquet \[([^\]]*)\].*?Location: \w+\(\d+ paths?\)\[([^\]]*)\]", l)
        if m:
            scans.append(f"{os.path.basename(m.group(2)).replace('.parquet', '')}({len(m.group(1).split(','))} cols)")
    return {
        "shuffles": sum("Exchange hashpartitioning" in l or "Exchange rangepartitioning" in l for l in lines),
        "single": sum("Exchange SinglePartition" in l for l in lines),
        "spread": sum("RoundRobinPartitioning" in l for l in lines),
        "broadcasts": sum("BroadcastExchange" in l for l in lines),
        "joins": ", ".join(f"{j.group(1)}/{j.group(2)}" for j in joins if j) or "—",
        "aggs": sum(bool(re.search(r"(Hash|Sort|ObjectHash)Aggregate", l)) for l in lines),
        "python": "Arrow UDF" if "ArrowEvalPython" in plan else ("row UDF" if "BatchEvalPython" in plan else "—"),
        "scans": ", ".join(scans),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    print(f"# Physical plans of the registered queries ({os.path.basename(sf)}, initial plan before AQE)\n")
    print("Shuffles = hash/range exchanges; single = single-partition exchanges (all above partial "
          "aggregates, checked by tests/test_plans.py); broadcasts are Spark's size-checked choices at "
          "this scale (they become sort-merge joins when the small side grows, and AQE re-plans from "
          "runtime sizes). Spread = round-robin exchanges of a caller's `input_partitions` (none by default).\n")
    print("| query | shuffles | spread | single | broadcasts | joins | aggregates | python | scans |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"| {name} | {s['shuffles']} | {s['spread']} | {s['single']} | {s['broadcasts']} | {s['joins']} | {s['aggs']} | "
              f"{s['python']} | {s['scans']} |")


if __name__ == "__main__":
    main()
