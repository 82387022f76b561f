"""Headline timings. Prints one JSON line.

Set BENCH_SF_DIR and BENCH_CPUS to change input and cores. Each query runs to the end with
its result discarded. A first round on the same data warms the JVM and is not timed.
"""

from __future__ import annotations

import json
import os
import time

from pagewatch.catalog.queries import QUERIES
from pagewatch.operators.profile import profile_captures
from pagewatch.session import local_session
from pagewatch.sources import derived

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def profile_pages(spark, sf_dir):
    return profile_captures(derived.page_captures(spark, sf_dir))


HEADLINE = {
    "profile_pages": profile_pages,
    "all_changes": QUERIES["i_all_changes"],
    "change_log": QUERIES["b9_change_log_rows"],
    "policy_alerts": QUERIES["i19_stealth_content_change"],
    "cycle_stats": QUERIES["d4_cycle_stats"],
    "document_keywords": QUERIES["h19_policy_keyword_counts"],
    "document_versions": QUERIES["h20_version_indicators"],
    "linked_document_changes": QUERIES["i12_linked_document_changes"],
    "event_previous_values": QUERIES["e1_previous_values"],
    "state_lookup": QUERIES["c1_previous_state_lookup"],
    "recheck_status": QUERIES["d3_recheck_status"],
    "canonical_json": QUERIES["h26_canonical_json"],
}


def run(spark, build) -> float:
    start = time.perf_counter()
    build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "pagewatch-bench")
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("profile_pages", "all_changes"):
        run(spark, HEADLINE[name])
    seconds = {name: round(run(spark, build), 3) for name, build in HEADLINE.items()}
    captures = derived.page_captures(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "captures": captures,
                "captures_per_second": round(captures / seconds["all_changes"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
