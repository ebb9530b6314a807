"""Time the headline queries and print one JSON line.

Each query runs once untimed (code generation, worker start) and once timed; results go to Spark's
no-op sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusfold.session import local_session  # noqa: E402
from corpusfold.workloads.registry import QUERIES  # noqa: E402

HEADLINE = (
    "token_counts", "select_files", "dir_summary", "token_distribution", "sort_tokens_topk",
    "delta_snapshot", "delta_directory", "dedupe_lines", "collapse_imports", "head_tail_sample",
    "markdown_outline", "objc_outline", "web_outline", "code_outline", "config_outline",
    "compress_corpus", "budget_levels", "drop_low_priority", "fit_document", "json_document",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
