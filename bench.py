"""Time the headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``.

Each query runs once cold and then ``BENCH_RUNS`` times; the best warm run counts.  Results go to
Spark's no-op sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from webstrata.registry import registered
from webstrata.session import local_session

HEADLINE = ["search_text", "search_nested", "search_documents", "page_results", "set_algebra", "saved_queries", "postings_build",
            "term_stats", "links", "broken_links", "title_audit", "content_quality", "page_scorecard", "render_blockers",
            "status_summary", "regex_extract", "page_components", "snippets", "markdown", "dedupe_latest"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "webstrata-bench")
    spark.sparkContext.setLogLevel("OFF")
    queries = registered()
    cold, warm = {}, {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name], warm[name] = round(times[0], 3), round(min(times[1:] or times), 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
