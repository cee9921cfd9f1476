"""Running totals, moving averages, first/last, daily ranks, contribution (q37-q46, v2, v3).

All series windows go through ``barlens.operators.windows``.
q46's per-date total is an aggregate joined back by broadcast: the per-date table
has at most one row per calendar day of the data's span, a bound that does not
grow with the number of series or rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.numeric import safe_div
from barlens.operators.windows import (with_first_last, with_frames_between, with_ranks, with_running,
                                       with_slides, with_sliding)
from barlens.schema import PRICE_SUM

_BASE = ["TradeDate", "IndexName", "ClosePrice"]


def q37_running_close(bars: DataFrame, strategy=None) -> DataFrame:
    """SUM over the default frame (RANGE): rows of the same date are added together."""
    d = with_running(bars, "IndexName", "TradeDate", {"RunningClosingPrice": ("sum", "ClosePrice")},
                     frame="range", strategy=strategy)
    return d.select(*_BASE, F.col("RunningClosingPrice").cast(PRICE_SUM).alias("RunningClosingPrice"))


def q38_running_volume(bars: DataFrame, strategy=None) -> DataFrame:
    """Running sum of positive volume; NULL until the first positive volume."""
    pos = F.when(F.col("Volume") > 0, F.col("Volume"))
    d = with_running(bars, "IndexName", "TradeDate", {"Running_Volume": ("sum", pos)},
                     frame="range", strategy=strategy)
    return d.select("TradeDate", "IndexName", "Volume", F.col("Running_Volume").cast("bigint"))


def q39_ma7(bars: DataFrame, strategy=None) -> DataFrame:
    d = with_sliding(bars, "IndexName", "TradeDate",
                     {"seven_day_moving_average_closeprice": ("avg", "ClosePrice", 7)}, strategy=strategy)
    return d.select(*_BASE, "seven_day_moving_average_closeprice")


def q40_ma30(bars: DataFrame, strategy=None) -> DataFrame:
    d = with_sliding(bars, "IndexName", "TradeDate",
                     {"thirty_days_moving_average_closingprice": ("avg", "ClosePrice", 30)},
                     strategy=strategy)
    return d.select(*_BASE, "thirty_days_moving_average_closingprice")


def q41_rolling_volume7(bars: DataFrame, strategy=None) -> DataFrame:
    """7 traded rows: the zero-volume filter comes before the window."""
    traded = bars.filter(F.col("Volume").isNotNull() & (F.col("Volume") > 0))
    d = with_sliding(traded, "IndexName", "TradeDate", {"RollingVolume7": ("int_avg", "Volume", 7)},
                     strategy=strategy)
    return d.select("TradeDate", "IndexName", "Volume", "RollingVolume7")


def q42_running_high(bars: DataFrame, strategy=None) -> DataFrame:
    d = with_running(bars, "IndexName", "TradeDate", {"RunningHighestClose": ("max", "ClosePrice")},
                     strategy=strategy)
    return d.select(*_BASE, "RunningHighestClose")


def q43_running_low(bars: DataFrame, strategy=None) -> DataFrame:
    d = with_running(bars, "IndexName", "TradeDate", {"RunningLowestClose": ("min", "ClosePrice")},
                     strategy=strategy)
    return d.select(*_BASE, "RunningLowestClose")


def q44_first_last_close(bars: DataFrame, strategy=None) -> DataFrame:
    d = with_first_last(bars, "IndexName", "TradeDate", "ClosePrice",
                        first="First_close_price", last="Last_close_price", strategy=strategy)
    return d.select(*_BASE, "First_close_price", "Last_close_price")


def q45_daily_ranking(bars: DataFrame, strategy=None) -> DataFrame:
    d = with_ranks(bars, "IndexName", "TradeDate", row_number="Row_Number", rank="Rank",
                   dense_rank="dense_rank", strategy=strategy)
    return d.select(*_BASE, "Row_Number", "Rank", "dense_rank")


def q46_contribution(bars: DataFrame) -> DataFrame:
    totals = bars.groupBy("TradeDate").agg(F.sum("ClosePrice").cast(PRICE_SUM)
                                           .alias("TotalClosePriceForThatDate"))
    d = bars.join(F.broadcast(totals), "TradeDate")
    return d.select(*_BASE, "TotalClosePriceForThatDate",
                    (safe_div("ClosePrice", "TotalClosePriceForThatDate") * F.lit(100.0))
                    .alias("PercentageContribution"))


def v2_moving_averages(bars: DataFrame, strategy=None, start=None, end=None) -> DataFrame:
    """7- and 30-row averages; with ``start``/``end`` only those dates, from the rows in
    the range and 29 before it."""
    outs = {"MovingAverage7": ("avg", "ClosePrice", 7), "MovingAverage30": ("avg", "ClosePrice", 30)}
    if start is None and end is None:
        d = with_sliding(bars, "Ticker", "TradeDate", outs, strategy=strategy)
    else:
        d = with_frames_between(bars, "Ticker", "TradeDate", 29, lambda f, w: with_slides(f, outs, w), start, end)
    return d.select("TradeDate", "Ticker", "IndexName", "ClosePrice", "MovingAverage7", "MovingAverage30")


def v3_running_metrics(bars: DataFrame, strategy=None) -> DataFrame:
    d = with_running(bars, "Ticker", "TradeDate",
                     {"RunningClose": ("sum", "ClosePrice"), "HighestRunningClose": ("max", "ClosePrice"),
                      "LowestRunningClose": ("min", "ClosePrice")}, strategy=strategy)
    return d.select("TradeDate", "Ticker", "IndexName", "ClosePrice",
                    F.col("RunningClose").cast(PRICE_SUM).alias("RunningClose"),
                    "HighestRunningClose", "LowestRunningClose")
