"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from paraseg.session import get_session
from workload.queries import QUERIES

HEADLINE = [
    "s1_segments",
    "c2_seeded_shuffle",
    "a1_align",
    "a2_alignment_check",
    "t7_modes",
    "t9_realign",
    "m3_bleu",
    "m6_chrf",
    "m10_score",
    "u4_usage_report",
    "r1_comparison",
    "r2_segment_delta",
    "r6_experiment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("m7_segment_scores")  # starts the JVM's code paths and the Python workers
    seconds = {name: run(name) for name in names}
    segments = QUERIES["s1_segments"](spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "lines": segments,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
