"""Benchmark: every registered key on stored bar tables, one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per key after one warm-up, default 3), BENCH_KEYS
(comma-separated substrings to select keys; default all).

The derived tables (bars, bars_dirty, dim_market, bars_wide) are built once from
the raw tables and written as parquet partitioned by year under the session's
checkpoint folder; those builds are timed too. Each key then runs on the stored
tables and is executed in full with the ``noop`` sink (nothing is collected).
Keys ending in ``__wide`` run on the 20,000-ticker table, a few ending in ``__raw``
on bars derived from the raw tables (not part of the total). ``wide_forms`` are keys on other
stored forms of the wide table (month states, bucketed by ticker, footers), and a sliding average of 7 and of 250 rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barlens.operators import month_state, procedures, returns, rolling, windows  # noqa: E402
from barlens.plans.catalog import ENTRIES, FORMS, WIDE_SUFFIX, RawSources, StoredSources, wide_keys  # noqa: E402
from barlens.session import build_session, ensure_checkpoint_dir  # noqa: E402
from barlens.sources import bars, bars_dirty, bars_wide, bucketed, dim_market, footers, read_bars, write_bars  # noqa: E402


RAW_KEYS = ["q19_daily_performance", "q31_mom_growth", "v6_market_summary", "d17_ranking"]


def _run(build) -> float:
    """Seconds to build the DataFrame (with any checkpoint that it writes) and execute it in full."""
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    pats = [p for p in os.environ.get("BENCH_KEYS", "").split(",") if p]
    parts = cpus
    spark = build_session(f"local[{cpus}]", parts, app_name="barlens-bench",
                          extra={"spark.driver.memory": "16g",
                                 # One machine: a scratch folder can stand for the shared one.
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="barlens-bench-")})
    root = os.path.join(ensure_checkpoint_dir(spark), f"bench-{uuid.uuid4().hex[:8]}")
    paths = {n: f"{root}/{n}" for n in ("bars", "dirty", "markets", "wide")}

    # One small untimed job first: the JVM's start and JIT warm-up are a session
    # cost, not a cost of building the tables.
    t0 = time.perf_counter()
    spark.range(2_000_000).selectExpr("id % 97 AS k", "id").groupBy("k").count() \
        .write.format("noop").mode("overwrite").save()
    warmup = time.perf_counter() - t0

    build = {}
    t0 = time.perf_counter()
    write_bars(bars(spark, sf_dir), paths["bars"], mode="overwrite")
    build["build_bars"] = time.perf_counter() - t0
    t0 = time.perf_counter()
    write_bars(bars_dirty(spark, sf_dir), paths["dirty"], mode="overwrite")
    build["build_bars_dirty"] = time.perf_counter() - t0
    dim_market(spark, sf_dir).write.mode("overwrite").parquet(paths["markets"])
    t0 = time.perf_counter()
    write_bars(bars_wide(spark, sf_dir), paths["wide"], mode="overwrite")
    build["build_bars_wide"] = time.perf_counter() - t0

    narrow = StoredSources(spark, paths["bars"], paths["dirty"], paths["markets"])
    wide = StoredSources(spark, paths["wide"])
    # Forms of a key build their stored table when they are called; they are timed below, over tables built once.
    jobs = [(k, narrow, fn) for k, (_, fn) in ENTRIES.items() if k not in FORMS]
    jobs += [(k + WIDE_SUFFIX, wide, ENTRIES[k][1]) for k in wide_keys()]
    # What a caller of queries() pays: the same keys from the raw tables, schema reads included.
    raw = RawSources(spark, sf_dir)
    jobs += [(k + "__raw", raw, ENTRIES[k][1]) for k in RAW_KEYS]
    if pats:
        jobs = [j for j in jobs if any(p in j[0] for p in pats)]

    timings, failed = {}, {}
    for key, src, fn in jobs:
        def make(fn=fn, src=src):
            return fn(src)
        try:
            _run(make)  # warm-up
            timings[key] = round(statistics.median(_run(make) for _ in range(runs)), 4)
        except Exception as e:  # noqa: BLE001 - report, keep benchmarking the rest
            failed[key] = str(e)[:200]

    def forms() -> dict:
        """The same keys on the wide table's other stored forms."""
        rows = read_bars(spark, paths["wide"], extra=["Year"])
        t0 = time.perf_counter()
        month_state.refresh(rows, f"{root}/months")
        build["build_month_states"] = time.perf_counter() - t0
        t0 = time.perf_counter()
        bucketed.write_bucketed(rows, "bench_bars", cpus, path=f"{root}/bucketed")
        build["build_bucketed"] = time.perf_counter() - t0
        state, by_ticker = month_state.read_state(spark, f"{root}/months"), bucketed.read_bucketed(spark, "bench_bars")
        made = {k + "_from_months": (lambda k=k: getattr(month_state, k)(state))
                for k in ("v4_monthly_performance", "v5_yearly_performance", "q29_yearly", "q31_mom_growth")}
        made |= {fn.__name__ + "_bucketed": (lambda fn=fn: fn(by_ticker)) for fn in (
            returns.v1_daily_performance, rolling.v2_moving_averages, rolling.v3_running_metrics, procedures.p3_latest_snapshot)}
        made |= {fn.__name__ + "_footers": (lambda fn=fn: fn(spark, paths["wide"])) for fn in (footers.q01_total_records, footers.q02_date_span)}
        made |= {f"moving_average_{n}_rows": (lambda n=n: windows.with_sliding(
            by_ticker, "Ticker", "TradeDate", {"a": ("avg", "ClosePrice", n)})) for n in (7, 250)}
        out = {}
        for key, make in made.items():
            _run(make)
            out[key] = round(statistics.median(_run(make) for _ in range(runs)), 4)
        return out

    try:
        form_timings = forms() if not pats else {}
    except Exception as e:  # noqa: BLE001
        form_timings, failed["forms"] = {}, str(e)[:200]

    raw_total = sum(v for k, v in timings.items() if k.endswith("__raw"))
    narrow_total = sum(v for k, v in timings.items() if not k.endswith((WIDE_SUFFIX, "__raw")))
    wide_total = sum(v for k, v in timings.items() if k.endswith(WIDE_SUFFIX))
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(narrow_total + wide_total, 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "wide_forms": form_timings,
        "bars_total_sec": round(narrow_total, 3),
        "bars_wide_total_sec": round(wide_total, 3),
        "raw_total_sec": round(raw_total, 3),
        "build_sec": {k: round(v, 3) for k, v in build.items()},
        "session_warmup_sec": round(warmup, 3),
        "runs": runs,
        "cpus": cpus,
        "shuffle_partitions": parts,
        "spark": spark.version,
        "failed": failed,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
