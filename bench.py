"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES (optional,
comma-separated, or ``all``) the queries. Each query runs once to warm up, then the
median of three runs counts. Results go to a sink that drops them, not to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tracelake.plans.queries import QUERIES
from tracelake.session import build_session

HEADLINE = (
    "exec_path_summary",
    "exec_path_frames",
    "step_frames",
    "traceback_frames",
    "filtered_trace_frames",
    "file_line_map",
    "variable_changes",
    "block_index",
    "parse_outcomes",
    "verdicts",
    "records",
    "run_metrics",
    "comparison_reports",
    "match_predictions",
    "source_context",
    "search_symbol",
    "search_requests",
    "open_ranges",
    "serialized_locals",
    "explode_hunks",
    "render_transcripts",
    "resolve_patches",
    "render_frames",
    "comparison_prompts",
    "strict_traces",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("tracelake-bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
