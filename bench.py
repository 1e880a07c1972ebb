"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from kinograph.queries import QUERIES
from kinograph.session import local_session

HEADLINE = ["contact_spans", "smoothed_series", "pair_distance", "nms_survivors", "merged_islands", "proposed_candidates", "greedy_matches", "prf_by_variant", "loco_summary", "slot_rollup", "parsed_responses", "audit_findings"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8, "8g")
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the second run has compiled code
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        seconds[name] = round(best, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
