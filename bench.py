"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores.  ``ingest`` renders, parses and stores the
tables; the queries after it read them, as they would in use.  Each query is timed with building
and running included (best of BENCH_REPEATS runs, default 1).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelathe.plans import views  # noqa: E402
from tracelathe.plans.catalog import QUERIES  # noqa: E402
from tracelathe.session import build_session  # noqa: E402

HEADLINE = [
    "parse_access", "parse_fsm", "run_status", "register_value_stats", "sequence_windows", "sequence_top10",
    "text_order_sequences", "fsm_summary", "interval_stats", "burst_stats", "run_activity", "error_context",
    "error_summary", "tfidf_terms", "important_registers", "doc_tfidf", "test_embedding", "access_vectors",
    "access_clusters", "value_vectors", "forest_flags", "embedding_pca", "run_features", "erratic_registers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session("bench", f"local[{cpus}]", os.environ.get("BENCH_SHUFFLE", cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")

    def timed(work) -> float:
        start = time.perf_counter()
        work()
        return time.perf_counter() - start

    def run(name):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    views.table(spark, sf_dir, "events").count()
    seconds = {"ingest": timed(lambda: views.tables(spark, sf_dir))}
    for name in HEADLINE:
        seconds[name] = min(timed(lambda: run(name)) for _ in range(repeats))
    seconds = {k: round(v, 3) for k, v in seconds.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
