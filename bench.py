"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and is then timed on a full run into the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from checks.compare import session  # noqa: E402

HEADLINE = [
    "k12_keyword_filter",
    "k12_keyword_filter_resumes",
    "k4_match_sentences",
    "k5_collect_matches",
    "p5_split_sentences",
    "p11_enrich",
    "r8_redact",
    "a3_scoring_prompts",
    "a4_batch_infer",
    "f3_apply_ai_results",
    "v1_rank_in_tier",
    "v2_tier_summary",
    "v3_results",
    "v4_top_n_per_job",
    "v8_explain",
    "l6_rescore",
    "l8_delete_cascade",
    "t5_progress_sessions",
    "t6_stale_runs",
    "t7_stage_timings",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        times[name] = round(run(spark, name, sf_dir), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
