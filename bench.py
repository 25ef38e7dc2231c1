"""Times headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query runs once to warm up and is then timed; the result goes to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "agg_01_bars_from_fills",
    "agg_01_bars_from_deals",
    "agg_03_volume_bars_carry",
    "agg_05_bars_from_books",
    "win_01_moving_bands",
    "win_06_ema",
    "win_11_adx",
    "join_06_markouts",
    "join_08_walk_book",
    "agg_10_return_metrics",
    "agg_11_trade_summary",
    "agg_16_correlations",
    "agg_22_value_at_risk",
    "pnl_05_parameter_sweep",
    "prj_11_trade_cost",
    "sig_39_aggregate",
    "sta_13_trade_bootstrap",
    "sta_15_ic_curve",
]


def main() -> None:
    from marketspark.plans import load_all
    from marketspark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if name not in registry:
            continue
        query = registry[name]
        for attempt in ("warm", "timed"):
            start = time.perf_counter()
            query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
