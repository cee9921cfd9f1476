"""Data-quality and inventory checks (q01-q10).

q01-q04 run on clean bars; q05-q10 on ``bars_dirty`` (clean data returns nothing).
All are one scan with a map-side partial aggregate or a pushed-down filter.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.schema import BAR_COLUMNS


def q01_total_records(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count(F.lit(1)).alias("Total_Records"))


def q02_date_span(bars: DataFrame) -> DataFrame:
    return bars.agg(F.min("TradeDate").alias("StartingDate"), F.max("TradeDate").alias("EndDate"))


def q03_distinct_indices(bars: DataFrame) -> DataFrame:
    return bars.agg(F.countDistinct("Ticker").alias("Number_of_Indices"))


def q04_records_per_ticker(bars: DataFrame) -> DataFrame:
    return bars.groupBy("Ticker").agg(F.count("TradeDate").alias("Records"))


def q05_duplicates(bars: DataFrame) -> DataFrame:
    """(TradeDate, Ticker) keys held by more than one row."""
    return (bars.groupBy("TradeDate", "Ticker").agg(F.count(F.lit(1)).alias("Total_Records"))
            .filter(F.col("Total_Records") > 1))


_NULL_PROFILE = [("PriceID", "null_priceid"), ("TradeDate", "null_trade_date"),
                 ("Ticker", "null_ticker"), ("IndexName", "null_index_name"),
                 ("OpenPrice", "null_open_price"), ("HighPrice", "null_high_price"),
                 ("LowPrice", "null_low_price"), ("ClosePrice", "null_close_price"),
                 ("Volume", "null_volume")]


def q06_null_profile(bars: DataFrame) -> DataFrame:
    """Row count and NULL count of the nine table columns, in one aggregate.

    Rows without the surrogate key yet (not stored) count none as NULL: it is NOT NULL
    by construction."""
    missing = lambda c: F.col(c).isNull() if c in bars.columns else F.lit(False)
    return bars.agg(F.count(F.lit(1)).alias("Total_Records"),
                    *[F.sum(F.when(missing(c), 1).otherwise(0)).alias(a) for c, a in _NULL_PROFILE])


def q07_invalid_prices(bars: DataFrame) -> DataFrame:
    return bars.filter((F.col("OpenPrice") <= 0) | (F.col("HighPrice") <= 0)
                       | (F.col("LowPrice") <= 0) | (F.col("ClosePrice") <= 0)).select(*BAR_COLUMNS)


def q08_price_consistency(bars: DataFrame) -> DataFrame:
    """As written: NOT(high ok) AND (low ok), so rows with a bad low are missed."""
    high_ok = (F.col("HighPrice") >= F.col("OpenPrice")) & (F.col("HighPrice") >= F.col("ClosePrice"))
    low_ok = (F.col("LowPrice") <= F.col("OpenPrice")) & (F.col("LowPrice") <= F.col("ClosePrice"))
    return bars.filter(~high_ok & low_ok).select(*BAR_COLUMNS)


def q08_price_consistency_intended(bars: DataFrame) -> DataFrame:
    """Intended: the high is not the top or the low is not the bottom of the bar."""
    high_ok = (F.col("HighPrice") >= F.col("OpenPrice")) & (F.col("HighPrice") >= F.col("ClosePrice"))
    low_ok = (F.col("LowPrice") <= F.col("OpenPrice")) & (F.col("LowPrice") <= F.col("ClosePrice"))
    return bars.filter(~(high_ok & low_ok)).select(*BAR_COLUMNS)


def q09_zero_volume(bars: DataFrame) -> DataFrame:
    """As written (titled a negative-volume check): Volume = 0."""
    return bars.filter(F.col("Volume") == 0).select(*BAR_COLUMNS)


def q09_zero_volume_intended(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("Volume") < 0).select(*BAR_COLUMNS)


def q10_future_dates(bars: DataFrame, as_of: _dt.date | None = None) -> DataFrame:
    """Rows dated after ``as_of`` (default: today)."""
    ref = F.lit(as_of) if as_of is not None else F.current_date()
    return bars.filter(F.col("TradeDate") > ref).select(*BAR_COLUMNS)
