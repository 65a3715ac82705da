"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query writes its whole result to the noop
sink, so nothing is pruned and nothing passes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from barcheck.plans.catalog import catalog
from barcheck.session import local_session, use_utc

HEADLINE = (
    "bars_daily", "gap_ticker_runs", "gap_listing", "gap_minutes", "gap_minute_dups", "dups", "stale_daily", "news_quality", "news_syndication",
    "split_gaps", "unrecorded_jumps", "panel_findings", "asof_join", "ledger_summary", "chain_verify", "trial_counts", "momentum_weights", "returns_net",
    "trade_episodes", "truncation_diff", "risk_summary", "dsr", "bootstrap_sharpe", "spa", "pbo", "shift_null", "bh", "concentration", "hac_alpha", "scorecard",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(app="bench")
    use_utc(spark)
    q = catalog()
    spark.read.parquet(f"{folder}/region.parquet").count()
    took: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        q[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
