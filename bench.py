"""Times the headline queries and prints one JSON line: the second run of each, and the first beside it.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from feedlens.session import build_session  # noqa: E402
from feedlens.workload import load  # noqa: E402

HEADLINES = [
    "trending_repos",
    "weekly_news",
    "topic_search",
    "dedup_articles",
    "sort_articles_composite",
    "term_frequencies",
    "relevance_score",
    "summarize",
    "assess_quality",
    "convert_articles",
    "extract_single_article",
    "page_links",
    "parse_rss",
    "latency_stats",
    "memory_levels",
    "top_keys",
    "select_for_cleanup",
    "validate_weekly_requests",
]


def _timed(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "feedlens-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executors
    cold, seconds = {}, {}
    for name in HEADLINES:
        cold[name] = _timed(queries[name], spark, sf_dir)  # compiles its code
        seconds[name] = _timed(queries[name], spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, second run",
                "value": round(sum(seconds.values()), 3),
                "first_run_value": round(sum(cold.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": cold,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
