"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stagehand.plans.catalogue import QUERIES
from stagehand.session import build

HEADLINE = "digest window_overlap merge_runs dedupe_first is_english audit_rules vector_topk vector_multi_phrase asof_preceding section_carry_forward tag_signatures snapshot_diff facet_cube event_windows interval_overlap_join".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", 8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, median of the runs after a first", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
