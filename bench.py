"""Seconds of the headline queries, as one line of JSON."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans.queries import QUERIES
from tidemark.session import local_session

HEADLINE = [
    "bars_h1", "bars_mid_m15", "bars_gap_filled", "resampled_h4", "forward_targets", "modality_statistics", "transitions", "segment_features", "context_sessions",
    "detector_atr_volatility", "detector_er_kaufman", "detector_adx", "detector_shannon", "detector_pca_axis", "detector_price_action", "detector_vpin", "detector_volume_profile", "detector_divergence_pv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_h1"](spark, sf_dir).count()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
