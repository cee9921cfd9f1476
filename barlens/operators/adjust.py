"""Bars adjusted for splits and dividends, the default of the vendor's bounded read.

A price before an ex-date is multiplied by the factor of that date's split and dividend, so it is
multiplied by the product of all later factors; a volume is divided by the splits' alone. Bars and factors
go through one window a ticker, latest first: no join of dates, and an ex-date on
which the ticker did not trade counts all the same.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.schema import BAR_COLUMNS, PRICE

PRICES = ["OpenPrice", "HighPrice", "LowPrice", "ClosePrice"]


def bounded(bars: DataFrame, start: _dt.date | None = None, end: _dt.date | None = None) -> DataFrame:
    """Raw bars of a range, ``end`` not included."""
    out = bars
    if start is not None:
        out = out.filter(F.col("TradeDate") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("TradeDate") < F.lit(end))
    return out.select(*BAR_COLUMNS)


def adjusted(bars: DataFrame, factors: DataFrame, start: _dt.date | None = None, end: _dt.date | None = None, *,
             volume: str = "bigint") -> DataFrame:
    """``bounded`` bars, adjusted by all factors after each bar, those after the range too.

    ``factors``: Ticker, ExDate, SplitFactor (0.5 for two new shares an old one) and
    DividendFactor (1 less the dividend's share of the close before); NULL means 1. Prices are
    rounded to the stored type, volumes to whole shares of type ``volume``. Some fifty halvings after a
    bar make its volume more than a bigint holds: the row stays with its prices, and its volume
    is NULL; "double" holds it."""
    rows = bounded(bars, start, end).withColumns({"_split": F.lit(1.0), "_cash": F.lit(1.0), "_bar": F.lit(0)})
    events = factors if start is None else factors.filter(F.col("ExDate") > F.lit(start))
    events = events.select(
        F.col("ExDate").alias("TradeDate"), "Ticker", F.coalesce("SplitFactor", F.lit(1.0)).alias("_split"),
        F.coalesce("DividendFactor", F.lit(1.0)).alias("_cash"), F.lit(1).alias("_bar"))
    both = rows.unionByName(events, allowMissingColumns=True)
    # A bar of the ex-date itself comes before the event: it trades at the new price already.
    later = Window.partitionBy("Ticker").orderBy(F.col("TradeDate").desc(), "_bar").rowsBetween(Window.unboundedPreceding, -1)
    split = F.coalesce(F.product("_split").over(later), F.lit(1.0))
    cash = F.coalesce(F.product("_cash").over(later), F.lit(1.0))
    out = both.withColumns({"_split": split, "_cash": cash}).filter(F.col("_bar") == 0)
    price = lambda c: F.round(F.col(c).cast("double") * F.col("_split") * F.col("_cash"), 4).cast(PRICE).alias(c)
    return out.select("TradeDate", "Ticker", "IndexName", *[price(c) for c in PRICES],
                      F.round(F.try_divide(F.col("Volume").cast("double"), F.col("_split"))).try_cast(volume).alias("Volume"))
