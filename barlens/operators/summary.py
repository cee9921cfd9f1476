"""Market summaries and top-1 questions (q11-q18, v6, p6).

Top-1 answers (``TOP 1 ... ORDER BY``) break ties by name so both engines pick the
same row; Spark plans ``orderBy().limit(1)`` as TakeOrderedAndProject (no global
sort). v6's latest close is ``max_by`` in the same aggregate instead of a
row_number self-join: one shuffle instead of two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.numeric import exact_avg, int_avg

def _range():
    return F.col("HighPrice") - F.col("LowPrice")


def _pos_vol():
    return F.when(F.col("Volume") > 0, F.col("Volume"))


def q11_market_summary(bars: DataFrame) -> DataFrame:
    return (bars.groupBy(F.col("IndexName").alias("Indexname"), "Ticker")
            .agg(F.count("TradeDate").alias("Trading_Days"),
                 F.min("TradeDate").alias("First_Trade_date"),
                 F.max("TradeDate").alias("Last_Trade_Date"),
                 F.max("ClosePrice").alias("Highest_Closing_Price"),
                 F.min("ClosePrice").alias("Lowest_Closing_Price"),
                 exact_avg("ClosePrice").alias("Average_Closing_Price"),
                 F.max("HighPrice").alias("Highest_high_price"),
                 F.min("HighPrice").alias("lowest_high_price"),
                 exact_avg(_range()).alias("Daily_Average")))


def q12_volume_profile(bars: DataFrame) -> DataFrame:
    return (bars.groupBy(F.col("IndexName").alias("Indexname"), "Ticker")
            .agg(F.max("Volume").alias("Highest_Volume"),
                 F.min(_pos_vol()).alias("Lowest_Non_Zero_Volume"),
                 int_avg(_pos_vol()).alias("Average_Volume"),
                 F.sum(F.when((F.col("Volume") == 0) | F.col("Volume").isNull(), 1).otherwise(0))
                 .alias("Number_of_zero_volume_days")))


def _top1(df: DataFrame, by, asc: bool, cols: list[str], tie: str = "IndexName") -> DataFrame:
    o = by.asc() if asc else by.desc()
    return df.orderBy(o, F.col(tie).asc()).limit(1).select(*cols)


def q13_highest_close_index(bars: DataFrame) -> DataFrame:
    g = bars.groupBy("IndexName").agg(F.max("ClosePrice").alias("highest_closing_value"))
    return _top1(g, F.col("highest_closing_value"), False, ["IndexName", "highest_closing_value"])


def q14_lowest_close_index(bars: DataFrame) -> DataFrame:
    g = bars.groupBy("IndexName").agg(F.min("ClosePrice").alias("lowest_closing_value"))
    return _top1(g, F.col("lowest_closing_value"), True, ["IndexName", "lowest_closing_value"])


def q15_largest_range_index(bars: DataFrame) -> DataFrame:
    """As written: shows AVG(High-Low) but ranks by AVG(High-Close)."""
    g = bars.groupBy("IndexName").agg(
        exact_avg(_range()).alias("Average_Closing_Price"),
        exact_avg(F.col("HighPrice") - F.col("ClosePrice")).alias("_sort"))
    return _top1(g, F.col("_sort"), False, ["IndexName", "Average_Closing_Price"])


def q15_largest_range_index_intended(bars: DataFrame) -> DataFrame:
    g = bars.groupBy("IndexName").agg(exact_avg(_range()).alias("Average_Daily_Range"))
    return _top1(g, F.col("Average_Daily_Range"), False, ["IndexName", "Average_Daily_Range"])


def q16_highest_avg_close_index(bars: DataFrame) -> DataFrame:
    g = bars.groupBy("IndexName").agg(exact_avg("ClosePrice").alias("Average_Closing_Price"))
    return _top1(g, F.col("Average_Closing_Price"), False, ["IndexName", "Average_Closing_Price"])


def q17_most_trading_days(bars: DataFrame) -> DataFrame:
    g = bars.groupBy("IndexName").agg(F.count("TradeDate").alias("Trading_Days"))
    return _top1(g, F.col("Trading_Days"), False, ["IndexName", "Trading_Days"])


def q18_distribution(bars: DataFrame) -> DataFrame:
    """Records per (index, year), then per index: total, years, truncated average."""
    yearly = bars.groupBy("IndexName", F.year("TradeDate").alias("Trading_Year")).agg(
        F.count("TradeDate").alias("TotalRecords"))
    return (yearly.groupBy("IndexName")
            .agg(F.sum("TotalRecords").alias("Total_Trading_Days"),
                 F.count("Trading_Year").alias("Total_Trading_Years"),
                 int_avg("TotalRecords").alias("Average_Records_Per_Year"))
            .orderBy(F.col("Average_Records_Per_Year").desc(), "IndexName"))


V6_COLUMNS = ["Ticker", "IndexName", "TradingDays", "FirstTradeDate", "LatestTradeDate",
              "LatestClosePrice", "AverageClosePrice", "HighestClosePrice", "LowestClosePrice",
              "HighestHighPrice", "LowestLowPrice", "AverageDailyRange", "AverageVolume",
              "HighestTradingVolume"]


def v6_market_summary(bars: DataFrame) -> DataFrame:
    """One row per (ticker, index name) with the ticker's latest close.

    One aggregate over the rows. A ticker that changed its index name has a row for
    each name, both with the close of the ticker's last date; that is taken over the
    aggregated rows, which are as many as markets.
    """
    pos = F.when(F.col("Volume") > 0, F.col("Volume"))
    per_name = bars.groupBy("Ticker", "IndexName").agg(
        F.count(F.lit(1)).alias("TradingDays"),
        F.min("TradeDate").alias("FirstTradeDate"),
        F.max("TradeDate").alias("LatestTradeDate"),
        F.max_by("ClosePrice", "TradeDate").alias("_close"),
        exact_avg("ClosePrice").alias("AverageClosePrice"),
        F.max("ClosePrice").alias("HighestClosePrice"),
        F.min("ClosePrice").alias("LowestClosePrice"),
        F.max("HighPrice").alias("HighestHighPrice"),
        F.min("LowPrice").alias("LowestLowPrice"),
        exact_avg(_range()).alias("AverageDailyRange"),
        (F.sum(pos).cast("double") / F.nullif(F.count(pos), F.lit(0))).alias("AverageVolume"),
        F.max("Volume").alias("HighestTradingVolume"))
    w = Window.partitionBy("Ticker").orderBy(F.col("LatestTradeDate").desc(), "IndexName")
    return per_name.withColumn("LatestClosePrice", F.first("_close").over(w)).select(*V6_COLUMNS)


def p6_executive_summary(bars: DataFrame) -> DataFrame:
    return v6_market_summary(bars).orderBy(F.col("LatestClosePrice").desc(), "Ticker")
