"""Print the physical plans of representative queries (scan pruning, pushed filters,
partial aggregation, window group limits, join strategies).

    python tools/explain_plans.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["freshness", "volume_anomaly", "zero_row_days", "hop_volume", "blast_radius"]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from tracehound.plans.queries import QUERIES
    from tracehound.session import build_session
    spark = build_session("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for n in a.names or DEFAULT:
        print(f"==== {n} ====")
        QUERIES[n](spark, a.sf).explain(a.mode)
    spark.stop()


if __name__ == "__main__":
    main()
