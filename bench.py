"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.  Every
query is run to completion without moving its rows to the driver; the best of the runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lumigrid.plans import all_queries  # noqa: E402
from lumigrid.session import build_session  # noqa: E402

HEADLINES = [
    "J02_logical_layers", "J03_best_layer", "J04_resolve_rgba", "J05_assemble_pixels",
    "J07_tone_map_hdr", "J09_normalize_depth", "J10_file_thumbnails", "J14_channel_groups",
    "J16_metadata_rows", "J22_parse_log", "J23_timing_summary", "T1_conflate", "T2_carry_forward",
    "T3_min_gap",
]
RUNS = 2
# Table, and rows or pixels that each of its rows stands for: input a second is reported for these.
INPUTS = {"J02_logical_layers": ("part", 1), "J03_best_layer": ("part", 1), "J04_resolve_rgba": ("part", 1),
          "J07_tone_map_hdr": ("lineitem", 1), "J09_normalize_depth": ("lineitem", 1),
          "J10_file_thumbnails": ("embeddings", 16)}


def _input_rows(spark, sf_dir: str, name: str) -> int:
    table, each = INPUTS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").count() * each


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = build_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    all_queries.QUERIES["J07_tone_map"](spark, sf_dir).count()  # start-up
    seconds = {}
    for name in only or HEADLINES:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    rates = {name: round(_input_rows(spark, sf_dir, name) / s) for name, s in seconds.items() if name in INPUTS}
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "rates": rates, "sf": Path(sf_dir).name.removeprefix("sf"),
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
