"""Headline queries timed on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workgraph.plans import QUERIES  # noqa: E402
from workgraph.session import build_session  # noqa: E402

HEADLINE = ["companion_hotspots", "co_change_pairs", "ready_queue", "board_view", "parse_entries", "log_search", "pair_rows",
            "parse_patches", "refresh_states", "changed_symbols", "import_scope", "test_reach", "match_steps", "score_cases",
            "verify_evidence", "md_blocks", "rolling_median"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "20g")})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's readers and code generation outside the timings.
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale.group(1)) if scale else None}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
