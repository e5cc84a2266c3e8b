"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans.queries import run  # noqa: E402
from tidemark.session import build_session, clear_shared  # noqa: E402

HEADLINE = [
    "e2_enriched_health",
    "f2_slo_summary",
    "e3_health_sync",
    "g4_recent_checks",
    "c3_columns",
    "c4_insert_edges",
    "c7_workflow_definitions",
    "g1_merged_definitions",
    "g2_merged_edges",
    "h4_levels",
    "h5_upstream",
    "f5_distinct_profile",
    "f6_f7_types",
    "f8_numeric_stats",
    "f9_duplicate_rows",
    "f12_quality_checks",
    "d1_line_chunks",
    "d2_chunk_vectors",
    "d3_cosine_top_k",
    "d8_prompts",
    "a6_vector_upsert",
    "k1_stream_throughput",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "*"))

    def measure(name: str) -> float:
        start = time.perf_counter()
        run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds = round(time.perf_counter() - start, 3)
        clear_shared(spark)
        return seconds

    for name in ("f2_slo_summary", "d1_line_chunks"):  # start the JVM and Python workers
        measure(name)
    seconds = {name: measure(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
