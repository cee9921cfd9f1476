"""Physical plan shape of every key on stored bar tables, as a markdown table.

usage: python tools/plan_stats.py [sf_dir] > PLANS.md
Builds each key once and reads its plan: scans, shuffle Exchanges, broadcast
exchanges, Window, Sort, joins and whether the scan got pushed filters.
"""

from __future__ import annotations

import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barlens.plans.catalog import ENTRIES, WIDE_SUFFIX, StoredSources, wide_keys  # noqa: E402
from barlens.session import build_session, ensure_checkpoint_dir  # noqa: E402
from barlens.sources import bars, bars_dirty, bars_wide, dim_market, write_bars  # noqa: E402


def stats(plan: str) -> dict:
    lines = plan.splitlines()
    body = "\n".join(lines)
    return {
        "scan": len(re.findall(r"FileScan|Scan ExistingRDD|BatchScan", body)),
        "exchange": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
                                   body)),
        "broadcast": len(re.findall(r"BroadcastExchange", body)),
        "window": len(re.findall(r"\bWindow \[", body)) + len(re.findall(r"\bWindowGroupLimit", body)),
        "sort": len(re.findall(r"\bSort \[", body)),
        "join": len(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)", body)),
        "pushed": "PushedFilters: [I" in body or "PushedFilters: [E" in body or "PushedFilters: [G" in body,
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8, app_name="barlens-plans")
    root = os.path.join(ensure_checkpoint_dir(spark), f"plans-{uuid.uuid4().hex[:8]}")
    write_bars(bars(spark, sf_dir), f"{root}/bars", mode="overwrite")
    write_bars(bars_dirty(spark, sf_dir), f"{root}/dirty", mode="overwrite")
    dim_market(spark, sf_dir).write.mode("overwrite").parquet(f"{root}/markets")
    write_bars(bars_wide(spark, sf_dir), f"{root}/wide", mode="overwrite")
    narrow = StoredSources(spark, f"{root}/bars", f"{root}/dirty", f"{root}/markets")
    wide = StoredSources(spark, f"{root}/wide")
    jobs = [(k, narrow, fn) for k, (_, fn) in ENTRIES.items()]
    jobs += [(k + WIDE_SUFFIX, wide, ENTRIES[k][1]) for k in wide_keys()]
    print(f"# Plan shape per key (stored tables from {sf_dir}, Spark {spark.version}, local[8], 8 shuffle partitions)\n")
    print("Counts are nodes of the plan that a call returns, before adaptive execution; what a key writes while it is "
          "built (`write_once`) is a scan here. Exchange = shuffle; broadcast = broadcast exchange.\n")
    print("| key | scans | Exchange | broadcast | Window | Sort | Join | pushed filter |")
    print("|---|---|---|---|---|---|---|---|")
    for key, src, fn in jobs:
        s = stats(fn(src)._jdf.queryExecution().executedPlan().toString())
        print(f"| {key} | {s['scan']} | {s['exchange']} | {s['broadcast']} | {s['window']} | {s['sort']} | {s['join']} | "
              f"{'yes' if s['pushed'] else ''} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
