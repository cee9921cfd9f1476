"""Every registered query: key -> callable(spark, sf_dir) -> DataFrame.

object, so one definition runs on tables derived from the driver's raw tables
(``RawSources``), on the 20,000-ticker scale table (``WideSources``, keys with
the ``__wide`` suffix) or on stored parquet (``StoredSources``, used by
bench.py). Clean-bar keys read ``bars``; q05-q10 and e06 read ``dirty``; the load
keys read ``feed``/``history``. Parameters are the fixture's sample calls.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.operators import (adjust, append, calendar, ingest, measures, month_state, procedures, quality, returns,
                               rolling, summary)
from barlens.sources import (bars, bars_dirty, bars_wide, bucketed, dim_market, feed, feed_dirty, feed_wide, footers, history,
                             price_factors, write_bars, write_once)
from barlens.schema import BAR_COLUMNS, FEED_RENAMES
from barlens.sources.bars import DEFAULT_START, HISTORY_BEFORE, HISTORY_MISSING_TICKER, as_vendor, factors_of, with_planted_faults
from barlens.session import ensure_checkpoint_dir
from barlens.sources.files import read_bars

# Fixed parameters of the registered calls.
AS_OF = _dt.date(2026, 1, 1)
P1_TICKER = "2-HIGH"
P2_RANGE = (_dt.date(1999, 1, 1), _dt.date(1999, 12, 31))
P4_N = 3
S03_RANGE = (_dt.date(1996, 3, 5), _dt.date(1999, 1, 1))
BUCKETS = 8
P5_YEAR = 1999
LOAD_STAMP = _dt.datetime(2026, 1, 1, 0, 0, 0)
SLICER = {"countries": ["ASIA"], "start": _dt.date(1997, 1, 1), "end": _dt.date(1999, 12, 31)}
RECENT = {"start": _dt.date(1999, 3, 1), "end": _dt.date(1999, 3, 31)}

Query = Callable[[SparkSession, str], DataFrame]


class RawSources:
    """Inputs derived from the driver's tables in ``sf_dir`` (lazily, per call)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def bars(self) -> DataFrame:
        return bars(self.spark, self.sf_dir)

    def dirty(self) -> DataFrame:
        return bars_dirty(self.spark, self.sf_dir)

    def markets(self) -> DataFrame:
        return dim_market(self.spark, self.sf_dir)

    def feed(self) -> DataFrame:
        return feed(self.spark, self.sf_dir)

    def feed_dirty(self) -> DataFrame:
        return feed_dirty(self.spark, self.sf_dir)

    def feed_wide(self) -> DataFrame:
        return feed_wide(self.spark, self.sf_dir)

    def factors(self) -> DataFrame:
        return price_factors(self.spark, self.sf_dir)

    def history(self) -> DataFrame:
        return history(self.spark, self.sf_dir)


class WideSources(RawSources):
    """The scale table: one ticker per part (only bar-only keys run on it)."""

    def bars(self) -> DataFrame:
        return bars_wide(self.spark, self.sf_dir)


class StoredSources(RawSources):
    """Inputs read from stored parquet tables (``write_bars`` layout)."""

    def __init__(self, spark: SparkSession, bars_path: str, dirty_path: str | None = None,
                 markets_path: str | None = None):
        self.spark = spark
        self.paths = (bars_path, dirty_path, markets_path)

    def bars(self) -> DataFrame:
        return read_bars(self.spark, self.paths[0], extra=["Year"])

    def dirty(self) -> DataFrame:
        return read_bars(self.spark, self.paths[1])

    def markets(self) -> DataFrame:
        return self.spark.read.parquet(self.paths[2])

    def feed(self) -> DataFrame:
        back = {v: k for k, v in FEED_RENAMES.items()}
        return self.bars().select(*[F.col(c).alias(back.get(c, c)) for c in BAR_COLUMNS if c != "IndexName"])

    def feed_dirty(self) -> DataFrame:
        return with_planted_faults(self.feed())

    def feed_wide(self) -> DataFrame:
        return as_vendor(self.feed(), self.markets())

    def factors(self) -> DataFrame:
        return factors_of(self.bars())

    def history(self) -> DataFrame:
        return self.bars().filter((F.col("TradeDate") < F.lit(HISTORY_BEFORE))
                                  & (F.col("Ticker") != F.lit(HISTORY_MISSING_TICKER)))


def _new_rows(s: RawSources) -> DataFrame:
    return ingest.e04_incremental_rows(s.feed(), s.history(), s.markets(), DEFAULT_START)


def _e07(s: RawSources) -> DataFrame:
    # The loaded table and the batch exist at rest before an append: each is written
    # once to the shared checkpoint folder instead of being derived again by every
    # branch that reads it (keys, offsets, rows).
    ensure_checkpoint_dir(s.spark)
    table = ingest.stored(s.history()).checkpoint(eager=True)
    return ingest.e07_append(table, _new_rows(s).checkpoint(eager=True), created_at=LOAD_STAMP)


def _scratch(s: RawSources, name: str) -> str:
    return f"{ensure_checkpoint_dir(s.spark)}/{name}-{uuid.uuid4().hex}"


def _stored_months(s: RawSources) -> tuple[str, str]:
    """Paths of the bars and of their month states, loaded in three appends, each with late rows of earlier months."""
    bars_path, state_path = _scratch(s, "bars"), _scratch(s, "months")
    rows = write_once(s.bars().select(*BAR_COLUMNS), "feed")
    third = F.pmod(F.hash("TradeDate"), F.lit(3))
    for k in range(3):
        month_state.append(s.spark, rows.filter(third == k), bars_path, state_path)
    return bars_path, state_path


def _months(fn, **kw):
    return lambda s: fn(month_state.read_state(s.spark, _stored_months(s)[1]), **kw)


def _sliced_months(s: RawSources) -> DataFrame:
    bars_path, state_path = _stored_months(s)
    return month_state.d21_slicer(month_state.read_state(s.spark, state_path), read_bars(s.spark, bars_path, extra=["Year"]),
                                  s.markets(), **SLICER)


def _bucketed(s: RawSources, rows: DataFrame) -> str:
    """The name of a table of ``rows``, bucketed by ticker."""
    table = f"bars_{uuid.uuid4().hex}"
    bucketed.write_bucketed(rows, table, BUCKETS, path=_scratch(s, table))
    return table


def _on_buckets(fn, **kw):
    return lambda s: fn(bucketed.read_bucketed(s.spark, _bucketed(s, s.bars())), **kw)


def _append_to_buckets(s: RawSources) -> DataFrame:
    table = _bucketed(s, ingest.stored(write_once(s.history(), "history")))
    bucketed.append_bucketed(s.spark, write_once(_new_rows(s), "batch"), table, BUCKETS, created_at=LOAD_STAMP)
    return s.spark.table(table)


def _append_checked(s: RawSources) -> DataFrame:
    path = _scratch(s, "bars")
    write_bars(ingest.stored(write_once(s.history(), "history")), path)
    stored = read_bars(s.spark, path, extra=["PriceID", "CreatedAt"])
    append.append_checked(stored, _new_rows(s), path, created_at=LOAD_STAMP)
    return read_bars(s.spark, path, extra=["PriceID", "CreatedAt"])


def _on_footers(fn):
    def run(s: RawSources) -> DataFrame:
        path = _scratch(s, "bars")
        write_bars(s.bars(), path)
        return fn(s.spark, path)
    return run


def _null_keys(s: RawSources) -> DataFrame:
    """The dirty bars with the planted faults of the feed: NULL dates and tickers too."""
    names = s.markets().select("Ticker", "IndexName")
    rows = s.feed_dirty().withColumnsRenamed(FEED_RENAMES)
    return rows.join(names, "Ticker", "left").select(*BAR_COLUMNS)


def _b(fn, **kw):
    return lambda s: fn(s.bars(), **kw)


def _d(fn, **kw):
    return lambda s: fn(s.dirty(), **kw)


def _bm(fn, **kw):
    return lambda s: fn(s.bars(), s.markets(), **kw)


# key -> (needs only bars?, fn(sources) -> DataFrame)
ENTRIES: dict[str, tuple[bool, Callable[[RawSources], DataFrame]]] = {}


def _reg(name: str, fn, bars_only: bool = True):
    ENTRIES[name] = (bars_only, fn)


for _name, _fn in [
    ("q01_total_records", quality.q01_total_records), ("q02_date_span", quality.q02_date_span),
    ("q03_distinct_indices", quality.q03_distinct_indices),
    ("q04_records_per_ticker", quality.q04_records_per_ticker),
]:
    _reg(_name, _b(_fn))
_reg("q05_duplicates", _d(quality.q05_duplicates), False)
_reg("q06_null_profile", _d(quality.q06_null_profile), False)
_reg("q06_null_profile_keys", lambda s: quality.q06_null_profile(ingest.with_price_id(_null_keys(s))), False)
_reg("q07_invalid_prices", _d(quality.q07_invalid_prices), False)
_reg("q08_price_consistency", _d(quality.q08_price_consistency), False)
_reg("q08_price_consistency_intended", _d(quality.q08_price_consistency_intended), False)
_reg("q09_zero_volume", _d(quality.q09_zero_volume), False)
_reg("q09_zero_volume_intended", _d(quality.q09_zero_volume_intended), False)
_reg("q10_future_dates", _d(quality.q10_future_dates, as_of=AS_OF), False)
for _mod, _names in [
    (summary, ["q11_market_summary", "q12_volume_profile", "q13_highest_close_index", "q14_lowest_close_index",
               "q15_largest_range_index", "q15_largest_range_index_intended", "q16_highest_avg_close_index",
               "q17_most_trading_days", "q18_distribution"]),
    (returns, ["q19_daily_performance", "q20_biggest_gain_day", "q21_biggest_loss_day", "q22_largest_change",
               "q22_largest_change_intended", "q23_largest_intraday", "q24_highest_volume_day",
               "q25_best_day_per_index", "q26_worst_day_per_index", "q26_worst_day_per_index_intended"]),
    (calendar, ["q27_monthly", "q28_quarterly", "q29_yearly", "q30_yoy_growth", "q30_yoy_growth_intended",
                "q31_mom_growth", "q32_best_year", "q33_worst_year", "q34_best_month", "q35_worst_month",
                "q36_monthly_consistency"]),
    (rolling, ["q37_running_close", "q38_running_volume", "q39_ma7", "q40_ma30", "q41_rolling_volume7",
               "q42_running_high", "q43_running_low", "q44_first_last_close", "q45_daily_ranking",
               "q46_contribution"]),
    (returns, ["v1_daily_performance", "v1_daily_performance_intended"]),
    (rolling, ["v2_moving_averages", "v3_running_metrics"]),
    (calendar, ["v4_monthly_performance", "v5_yearly_performance"]),
    (summary, ["v6_market_summary"]),
]:
    for _name in _names:
        _reg(_name, _b(getattr(_mod, _name)))
_reg("p1_market_history", _b(procedures.p1_market_history, ticker=P1_TICKER), False)
_reg("p2_market_by_date_range", _b(procedures.p2_market_by_date_range, start=P2_RANGE[0], end=P2_RANGE[1]))
_reg("p3_latest_snapshot", _b(procedures.p3_latest_snapshot))
_reg("p4_top_markets", _b(procedures.p4_top_markets, n=P4_N))
_reg("p5_monthly_performance", _b(calendar.p5_monthly_performance, year=P5_YEAR))
_reg("p6_executive_summary", _b(summary.p6_executive_summary))
_reg("e01_high_water_mark", lambda s: ingest.e01_high_water_mark(s.history(), s.markets()), False)
_reg("e02_start_date", lambda s: ingest.e02_start_date(
    ingest.e01_high_water_mark(s.history(), s.markets()), DEFAULT_START), False)
_reg("e03_conform", lambda s: ingest.e03_conform(s.feed(), s.markets()), False)
_reg("e03_rejects", lambda s: ingest.e03_rejects(s.feed_dirty(), s.markets()), False)
_reg("e03_conform_dirty", lambda s: ingest.e03_conform(s.feed_dirty(), s.markets()), False)
_reg("e04_incremental_rows", _new_rows, False)
_reg("e05_union", lambda s: ingest.e05_union(s.history(), _new_rows(s)), False)
_reg("e06_profile", _d(ingest.e06_profile), False)
_reg("e07_append", _e07, False)
for _name in ["d02_market_trend", "d03_best_worst", "d04_volume_trend", "d06_ytd_return", "d07_breadth",
              "d08_volume_kpis", "d09_volume_share", "d10_liquidity", "d11_rolling_vol20", "d13_risk_table",
              "d14_risk_score", "d15_volume_growth", "d16_composite", "d17_ranking", "d18_insights",
              "d19_drilldown"]:
    _reg(_name, _b(getattr(measures, _name)))
for _name in ["d01_kpis", "d05_regional", "d12_volatility_by_country", "d20_star"]:
    _reg(_name, _bm(getattr(measures, _name)), False)
_reg("d21_slicer", _bm(measures.d21_slicer, **SLICER), False)

# Bounded dates and slicers: windows see the rows before the range, results only the range.
for _name, _fn in [("v1_daily_performance_range", returns.v1_daily_performance),
                   ("v2_moving_averages_range", rolling.v2_moving_averages),
                   ("d11_rolling_vol20_range", measures.d11_rolling_vol20)]:
    _reg(_name, _b(_fn, **RECENT))
for _name, _fn in [("d03_best_worst_sliced", measures.d03_best_worst), ("d13_risk_table_sliced", measures.d13_risk_table),
                   ("d17_ranking_sliced", measures.d17_ranking)]:
    _reg(_name, (lambda f: lambda s: f(s.bars(), slicer=SLICER, markets=s.markets()))(_fn), False)

_reg("e03_flatten", lambda s: ingest.e03_flatten(s.feed_wide()), False)
_reg("s03_feed_range", lambda s: adjust.bounded(s.bars(), *S03_RANGE), False)
_reg("s03_feed_range_adjusted", lambda s: adjust.adjusted(s.bars(), s.factors(), *S03_RANGE), False)

# Other plans of a key, over other stored forms: variant -> key.
FORMS: dict[str, str] = {}


def _form(key: str, suffix: str, fn):
    FORMS[key + suffix] = key
    _reg(key + suffix, fn, False)


for _name in ["v4_monthly_performance", "v5_yearly_performance", "q27_monthly", "q28_quarterly", "q29_yearly",
              "q30_yoy_growth", "q31_mom_growth", "d02_market_trend", "d04_volume_trend"]:
    _form(_name, "_from_months", _months(getattr(month_state, _name)))
_form("q30_yoy_growth_intended", "_from_months", _months(month_state.q30_yoy_growth, percent=True))
_form("p5_monthly_performance", "_from_months", _months(month_state.p5_monthly_performance, year=P5_YEAR))
_form("d01_kpis", "_from_months", lambda s: month_state.d01_kpis(
    month_state.read_state(s.spark, _stored_months(s)[1]), s.markets()))
_form("d21_slicer", "_from_months", _sliced_months)
for _name, _fn in [("v1_daily_performance", returns.v1_daily_performance), ("v2_moving_averages", rolling.v2_moving_averages),
                   ("v3_running_metrics", rolling.v3_running_metrics), ("p3_latest_snapshot", procedures.p3_latest_snapshot)]:
    _form(_name, "_bucketed", _on_buckets(_fn))
_form("e07_append", "_bucketed", _append_to_buckets)
_form("e07_append", "_checked", _append_checked)
_form("q01_total_records", "_footers", _on_footers(footers.q01_total_records))
_form("q02_date_span", "_footers", _on_footers(footers.q02_date_span))

WIDE_SUFFIX = "__wide"


def wide_keys() -> list[str]:
    return [k for k, (bars_only, _) in ENTRIES.items() if bars_only]


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for name, (_, fn) in ENTRIES.items():
        q[name] = (lambda f: lambda spark, sf_dir: f(RawSources(spark, sf_dir)))(fn)
    for name in wide_keys():
        fn = ENTRIES[name][1]
        q[name + WIDE_SUFFIX] = (lambda f: lambda spark, sf_dir: f(WideSources(spark, sf_dir)))(fn)
    return q
