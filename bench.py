"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is built and its rows counted by a full write to a no-op sink, so
every column is computed. One small query runs first to start the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from placegraph import catalog
from placegraph.session import clear_run, local_session

HEADLINE = [
    "nodes_per_place", "reassign_place", "room_of_node", "nearest_node", "nearest_space", "space_overlap", "overlap_audit", "alignment_audit",
    "stair_stacking", "network_edges", "tidy_links", "node_labels", "unreachable_rooms", "stairwell_steps", "components", "route_costs",
    "route_legs", "leg_distances", "snapshot_diff", "apply_delta", "node_names", "suggest_rooms", "suggest_sections", "parse_refs", "now_next", "due_now",
    "favorite_state", "recents", "sessions", "touch_throttle", "coverage_rollup", "label_cleanup", "similarity_fit", "drawing_grid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    queries["place_rollup"](spark, sf_dir).collect()
    for name in names:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        clear_run(spark)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
