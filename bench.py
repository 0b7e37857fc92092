"""Benchmark the headline queries.

Runs each query fully (``noop`` sink, so every row is computed and nothing
is collected) at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship",
    "chat_render",
    "length_filter",
    "length_percentile_filter",
    "exact_split_members",
    "reward_total",
    "group_advantage",
    "reward_answer_nb",
    "eval_metrics",
    "pair_summary",
    "ground_truth_lookup",
    "verdict_flatten",
    "judge_outcomes",
    "answer_recovery",
    "html_unescape",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    os.environ["BENCH_CPUS"] = cpus
    from tessera.plans.catalog import QUERIES
    from tessera.plans.fixtures import set_input_partitions
    from tessera.plans.flagship import flagship
    from tessera.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    set_input_partitions(int(cpus))  # each table is one row group
    queries = dict(QUERIES)
    queries["flagship"] = flagship
    # JVM / JIT / Python-worker warm-up: every headline query once on the smallest
    # fixture (not timed), so timings measure steady-state query cost.
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for name in HEADLINE:
            queries[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
