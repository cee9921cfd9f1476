"""The stored procedures as parameterised functions (p1-p4; p5 in calendar, p6 in summary)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.schema import BAR_COLUMNS


def between_dates(bars: DataFrame, start: _dt.date | None = None, end: _dt.date | None = None) -> DataFrame:
    """Bars with start <= TradeDate <= end. On a table with its Year column, whole year
    folders are pruned as well."""
    b = bars
    for bound, ok in ((start, lambda c, v: c >= F.lit(v)), (end, lambda c, v: c <= F.lit(v))):
        if bound is not None:
            b = b.filter(ok(F.col("TradeDate"), bound))
            if "Year" in bars.columns:
                b = b.filter(ok(F.col("Year"), bound.year))
    return b


def p1_market_history(bars: DataFrame, ticker: str) -> DataFrame:
    """All bars of one ticker by date; the ticker filter reaches the parquet scan."""
    return bars.filter(F.col("Ticker") == F.lit(ticker)).select(*BAR_COLUMNS).orderBy("TradeDate")


def p2_market_by_date_range(bars: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """Bars with start <= TradeDate <= end, by date and ticker."""
    return between_dates(bars, start, end).select(*BAR_COLUMNS).orderBy("TradeDate", "Ticker")


def _latest(bars: DataFrame) -> DataFrame:
    # row_number() = 1 is planned as a WindowGroupLimit before the shuffle: each
    # map task forwards one row per ticker.
    w = Window.partitionBy("Ticker").orderBy(F.col("TradeDate").desc())
    return bars.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)


def p3_latest_snapshot(bars: DataFrame) -> DataFrame:
    return _latest(bars).select(*BAR_COLUMNS)


def p4_top_markets(bars: DataFrame, n: int) -> DataFrame:
    """Top n tickers by latest close level (the reference ranks by level, not return)."""
    return (_latest(bars).select("TradeDate", "Ticker", "IndexName", "ClosePrice")
            .orderBy(F.col("ClosePrice").desc(), "Ticker").limit(n))
