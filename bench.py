"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from calibra.registry import QUERIES
from calibra.session import session

HEADLINE = ["win_rate_by_price", "mispricing_by_price", "maker_vs_taker_returns", "ev_yes_vs_no", "volume_over_time", "longshot_volume_share", "maker_taker_gap_over_time", "trade_size_by_role", "category_returns", "calibration_metrics", "cumulative_win_rate", "mann_whitney", "clustered_se_event", "trade_cells", "ctf_win_rate"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = HEADLINE
    QUERIES[names[0]](spark, sf_dir).collect()  # warm-up
    took = {}
    for name in names:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
