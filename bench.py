"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from parcelscope.plans import catalog, driver_facts  # noqa: E402
from parcelscope.plans.driver_tables import Tables  # noqa: E402
from parcelscope.session import build_session  # noqa: E402

HEADLINE = (
    "RNK-1_ranking_snapshot", "WIN-1_ranking_per_scope", "JOI-3_decorated_list", "FIL-1_conjunction", "AGG-4_dashboard",
    "UWR-11_underwriting", "STG-8_all_strategies", "OFR-2_offer_grid", "SCO-5_scores", "FLG-11_flags_with_impact",
    "CHG-7_change_events", "RES-2_winners", "JOI-5_fuzzy_best_match", "IDN-1_resolved_identities", "DOC-1_classification",
    "DOC-3_sections", "EXT-2_validated_facts", "AGG-22_gut_correlation", "SNK-1_csv_export", "VIW-4_recompute",
    "VIW-4_recompute_from_facts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("parcelscope-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    registry, tables, took = catalog.load(), Tables(spark, folder), {}
    # The first job pays for starting the session; the ledger's own generation is not part of any headline query.
    driver_facts.ledger(tables).limit(1).collect()
    only = set(sys.argv[1:])
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        registry[name].run(tables).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 2)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took,
                      "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
