"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each query is executed in full with the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "walk_upstream",      # multi-source evidence walk, one start per line item
    "walk_downstream",    # hub walk: every region to the whole graph
    "walk_capped",        # blast-radius caps from every customer and supplier
    "entity_enrich",      # walk + enrichment join
    "rank_suspects",      # walk + enrichment + signals + distance + ranking
    "blast_radius",       # capped downstream walks + labels + aggregates
    "tags_add",           # full investigation with containment writes and read-back
    "volume_anomaly",     # X1
    "zero_row_days",      # X5
    "hop_volume",         # X6
    "signals_union",      # X7
    "chain_edges",        # W7
    "report_text",        # full investigation with containment, as text
    "writeback_proof",    # C7
    "lineage_dot",        # drawings
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from tracehound.plans.queries import QUERIES
    from tracehound.session import build_session
    spark = build_session(f"local[{cpus}]", int(cpus), app_name="tracehound-bench",
                          extra={"spark.ui.showConsoleProgress": "false",
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tracehound-bench-"),
                                 "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    # untimed warm-up (JVM, JIT, codegen caches): a small walk over the events table
    QUERIES["walk_cyclic"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
