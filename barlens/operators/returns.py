"""Daily performance, returns and best/worst days (q19-q26, v1).

The previous close is a per-series LAG (``windows.with_lag``). Best/worst day per index is ``row_number() ... = k``, which Spark plans
with a WindowGroupLimit on both sides of the shuffle, so only k rows per index
and map task cross the network however large one index is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.numeric import pct_change, to_double
from barlens.operators.windows import with_frames_between, with_lag


def _with_prev(bars: DataFrame, part: str = "IndexName", strategy=None) -> DataFrame:
    return with_lag(bars, part, "TradeDate", "ClosePrice", "_prev", strategy=strategy)


def q19_daily_performance(bars: DataFrame, strategy=None) -> DataFrame:
    d = _with_prev(bars, strategy=strategy)
    return d.select("TradeDate", "IndexName", "Ticker", "ClosePrice",
                    F.col("_prev").alias("previous_close_price"),
                    (F.col("ClosePrice") - F.col("_prev")).alias("ClosePrice_change"),
                    pct_change("ClosePrice", "_prev").alias("ClosePrice_change_pct"))


def _returns(bars: DataFrame, strategy=None) -> DataFrame:
    d = _with_prev(bars, strategy=strategy)
    return d.select(F.col("TradeDate").alias("Date"), F.col("IndexName").alias("Index"),
                    F.col("ClosePrice").alias("Currentprice"),
                    F.col("_prev").alias("Previous_closeprice"),
                    pct_change("ClosePrice", "_prev").alias("_ret"))


def _day(bars: DataFrame, asc: bool, strategy=None) -> DataFrame:
    r = _returns(bars, strategy).filter(F.col("Previous_closeprice").isNotNull())
    o = F.col("_ret").asc_nulls_first() if asc else F.col("_ret").desc_nulls_last()
    return (r.orderBy(o, "Index", "Date").limit(1)
            .select("Date", "Index", "Currentprice", "Previous_closeprice",
                    F.round("_ret", 2).alias("daily_return_average")))


def q20_biggest_gain_day(bars: DataFrame, strategy=None) -> DataFrame:
    return _day(bars, asc=False, strategy=strategy)


def q21_biggest_loss_day(bars: DataFrame, strategy=None) -> DataFrame:
    return _day(bars, asc=True, strategy=strategy)


def _changes(bars: DataFrame, strategy=None) -> DataFrame:
    d = _with_prev(bars, strategy=strategy)
    return d.select(F.col("TradeDate").alias("Date"), F.col("IndexName").alias("Index"),
                    F.col("ClosePrice").alias("Currentclose"),
                    F.col("_prev").alias("previousclose_price"),
                    (F.col("ClosePrice") - F.col("_prev")).alias("close_price_change"))


def q22_largest_change(bars: DataFrame, strategy=None) -> DataFrame:
    """As written: the largest rise (no ABS)."""
    return (_changes(bars, strategy).orderBy(F.col("close_price_change").desc_nulls_last(), "Index", "Date")
            .limit(1))


def q22_largest_change_intended(bars: DataFrame, strategy=None) -> DataFrame:
    """Largest move either way."""
    return (_changes(bars, strategy)
            .orderBy(F.abs("close_price_change").desc_nulls_last(), "Index", "Date").limit(1))


def q23_largest_intraday(bars: DataFrame) -> DataFrame:
    d = bars.select(F.col("TradeDate").alias("Date"), F.col("IndexName").alias("Index"),
                    F.col("HighPrice").alias("High"), F.col("LowPrice").alias("Low"),
                    (F.col("HighPrice") - F.col("LowPrice")).alias("Intra_day_range"))
    return d.orderBy(F.col("Intra_day_range").desc_nulls_last(), "Index", "Date").limit(1)


def q24_highest_volume_day(bars: DataFrame) -> DataFrame:
    return (bars.select("TradeDate", "IndexName", "Volume")
            .orderBy(F.col("Volume").desc_nulls_last(), "IndexName", "TradeDate").limit(1))


def _ranked_days(bars: DataFrame, asc: bool, strategy=None) -> DataFrame:
    d = _with_prev(bars, strategy=strategy).select(
        "TradeDate", "IndexName", F.col("ClosePrice").alias("Currentclose"),
        F.col("_prev").alias("previousclose"),
        pct_change("ClosePrice", "_prev").alias("_ret"))
    o = F.col("_ret").asc_nulls_first() if asc else F.col("_ret").desc_nulls_last()
    w = Window.partitionBy("IndexName").orderBy(o, F.col("TradeDate").asc())
    return d.withColumn("_rnk", F.row_number().over(w))


def _day_out(d: DataFrame) -> DataFrame:
    return d.select("TradeDate", "IndexName", "Currentclose", "previousclose",
                    F.round("_ret", 2).alias("DailyReturnpct"))


def q25_best_day_per_index(bars: DataFrame, strategy=None) -> DataFrame:
    return _day_out(_ranked_days(bars, asc=False, strategy=strategy).filter(F.col("_rnk") == 1))


def q26_worst_day_per_index(bars: DataFrame, strategy=None) -> DataFrame:
    """As written: rank 2, because the NULL first-day return sorts first ascending."""
    return _day_out(_ranked_days(bars, asc=True, strategy=strategy).filter(F.col("_rnk") == 2))


def q26_worst_day_per_index_intended(bars: DataFrame, strategy=None) -> DataFrame:
    d = _with_prev(bars, strategy=strategy).select(
        "TradeDate", "IndexName", F.col("ClosePrice").alias("Currentclose"),
        F.col("_prev").alias("previousclose"),
        pct_change("ClosePrice", "_prev").alias("_ret")).filter(F.col("_ret").isNotNull())
    w = Window.partitionBy("IndexName").orderBy(F.col("_ret").asc(), F.col("TradeDate").asc())
    return _day_out(d.withColumn("_rnk", F.row_number().over(w)).filter(F.col("_rnk") == 1))


def _v1(bars: DataFrame, intended: bool, strategy=None, start=None, end=None) -> DataFrame:
    if start is None and end is None:
        d = with_lag(bars, "Ticker", "TradeDate", "ClosePrice", "PreviousClose", strategy=strategy)
    else:
        d = with_frames_between(bars, "Ticker", "TradeDate", 1, lambda f, w: f.withColumn(
            "PreviousClose", F.lag("ClosePrice").over(w)), start, end)
    c, p = F.col("ClosePrice"), F.col("PreviousClose")
    if intended:
        ret = pct_change(c, p)
    else:
        # The parenthesis of the original: Close - (Prev / Prev), times 100.
        ret = (to_double(c) - to_double(p) / F.nullif(to_double(p), F.lit(0.0))) * F.lit(100.0)
    change = F.when(c > p, "Up").when(c < p, "Down").otherwise("No Change")
    return d.select("TradeDate", "Ticker", "IndexName", "ClosePrice", "PreviousClose",
                    (c - p).alias("PriceChange"), ret.alias("DailyReturnPct"),
                    change.alias("MarketChange"))


def v1_daily_performance(bars: DataFrame, strategy=None, start=None, end=None) -> DataFrame:
    """Every row with its previous close; with ``start``/``end`` only those dates."""
    return _v1(bars, intended=False, strategy=strategy, start=start, end=end)


def v1_daily_performance_intended(bars: DataFrame, strategy=None, start=None, end=None) -> DataFrame:
    return _v1(bars, intended=True, strategy=strategy, start=start, end=end)
