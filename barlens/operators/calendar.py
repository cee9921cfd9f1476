"""Calendar rollups and growth (q27-q36, v4, v5, p5).

Each is a grouped aggregate on calendar expressions (partial + final aggregate
around one shuffle of the small per-group states); growth and best/worst
periods then window over the aggregated table, which holds one row per series
and period, so those windows stay small at any data size.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.operators.procedures import between_dates

from barlens.functions.dates import month_name, month_of, quarter_label, year_of
from barlens.functions.numeric import exact_avg, int_avg

def _range():
    return F.col("HighPrice") - F.col("LowPrice")


def _pos_vol():
    return F.when(F.col("Volume") > 0, F.col("Volume"))


def _growth(cur: str, prev: str, scale: float | None) -> F.Column:
    q = (F.col(cur) - F.col(prev)) / F.nullif(F.col(prev), F.lit(0.0))
    return q * F.lit(scale) if scale else q


def q27_monthly(bars: DataFrame) -> DataFrame:
    return (bars.groupBy("IndexName", year_of().alias("_Year"), month_of().alias("MonthNumber"),
                         month_name().alias("Month_Name"))
            .agg(F.count(F.lit(1)).alias("TradingDays"),
                 exact_avg("ClosePrice").alias("AverageClosingPrice"),
                 F.max("ClosePrice").alias("HighestClosingPrice"),
                 F.min("ClosePrice").alias("LowestClosingPrice"),
                 int_avg(_pos_vol()).alias("AverageVolume"),
                 exact_avg(_range()).alias("DailyAverage")))


def q28_quarterly(bars: DataFrame) -> DataFrame:
    return (bars.groupBy("IndexName", year_of().alias("Yearr"), quarter_label().alias("QuarterName"))
            .agg(F.count(F.lit(1)).alias("TradingDays"),
                 exact_avg("ClosePrice").alias("AverageClosingPrice"),
                 F.max("ClosePrice").alias("HighestClosingPrice"),
                 F.min("ClosePrice").alias("LowestClosingPrice"),
                 int_avg(_pos_vol()).alias("AverageVolume")))


def q29_yearly(bars: DataFrame) -> DataFrame:
    return (bars.groupBy("IndexName", year_of().alias("Yeaar"))
            .agg(F.count(F.lit(1)).alias("TradingDays"),
                 F.max("ClosePrice").alias("HighestClosePrice"),
                 F.min("ClosePrice").alias("LowestClosePrice"),
                 exact_avg("ClosePrice").alias("AverageClosingPrice"),
                 int_avg(_pos_vol()).alias("AverageVolume"),
                 F.max("Volume").alias("Highestvolume"),
                 F.min(_pos_vol()).alias("LowestVolume"))
            .orderBy("IndexName", "Yeaar"))


def _yoy(bars: DataFrame, scale: float | None, name: str) -> DataFrame:
    y = bars.groupBy("IndexName", year_of().alias("Yearr")).agg(
        exact_avg("ClosePrice").alias("CurrentAverageCp"))
    w = Window.partitionBy("IndexName").orderBy("Yearr")
    y = y.withColumn("prevAverageCp", F.lag("CurrentAverageCp").over(w))
    return (y.select("IndexName", "Yearr", "CurrentAverageCp", "prevAverageCp",
                     (F.col("CurrentAverageCp") - F.col("prevAverageCp")).alias("YoYChange"),
                     _growth("CurrentAverageCp", "prevAverageCp", scale).alias(name))
            .orderBy("IndexName", "Yearr"))


def q30_yoy_growth(bars: DataFrame) -> DataFrame:
    """As written: the growth is a fraction (no * 100)."""
    return _yoy(bars, None, "YoY_Growth")


def q30_yoy_growth_intended(bars: DataFrame) -> DataFrame:
    return _yoy(bars, 100.0, "YoY_Growth_Pct")


def q31_mom_growth(bars: DataFrame) -> DataFrame:
    m = bars.groupBy("IndexName", year_of().alias("Yearr"), month_name().alias("Month_Name"),
                     month_of().alias("mon")).agg(exact_avg("ClosePrice").alias("AverageCloseprice"))
    w = Window.partitionBy("IndexName").orderBy("Yearr", "mon")
    m = m.withColumn("prevcp", F.lag("AverageCloseprice").over(w))
    return (m.select("IndexName", "Yearr", "Month_Name", "mon", "AverageCloseprice", "prevcp",
                     _growth("AverageCloseprice", "prevcp", 100.0).alias("MoM_Growth_Pct"))
            .orderBy("IndexName", "Yearr", "mon"))


def _best_year(bars: DataFrame, desc: bool) -> DataFrame:
    y = bars.groupBy("IndexName", year_of().alias("Yearr")).agg(
        exact_avg("ClosePrice").alias("AverageClosePrice"))
    o = F.col("AverageClosePrice").desc() if desc else F.col("AverageClosePrice").asc()
    w = Window.partitionBy("IndexName").orderBy(o)
    return (y.withColumn("_rnk", F.rank().over(w)).filter(F.col("_rnk") == 1)
            .select("IndexName", "Yearr", "AverageClosePrice"))


def q32_best_year(bars: DataFrame) -> DataFrame:
    return _best_year(bars, desc=True)


def q33_worst_year(bars: DataFrame) -> DataFrame:
    return _best_year(bars, desc=False)


def _best_month(bars: DataFrame, desc: bool) -> DataFrame:
    h = bars.groupBy("IndexName", month_of().alias("Month_Number"), month_name().alias("Month_Name")) \
        .agg(exact_avg("ClosePrice").alias("AverageCp"))
    o = F.col("AverageCp").desc() if desc else F.col("AverageCp").asc()
    w = Window.partitionBy("IndexName").orderBy(o)
    return (h.withColumn("_rnk", F.rank().over(w)).filter(F.col("_rnk") == 1)
            .select("IndexName", "Month_Number", "Month_Name", "AverageCp").orderBy("IndexName"))


def q34_best_month(bars: DataFrame) -> DataFrame:
    """Calendar month with the highest average close over all years."""
    return _best_month(bars, desc=True)


def q35_worst_month(bars: DataFrame) -> DataFrame:
    return _best_month(bars, desc=False)


def q36_monthly_consistency(bars: DataFrame) -> DataFrame:
    m = bars.groupBy(F.col("IndexName").alias("Index"), year_of().alias("TradingYear"),
                     month_of().alias("MonthNumber")).agg(exact_avg("ClosePrice").alias("AvgMonthlyClose"))
    w = Window.partitionBy("Index").orderBy("TradingYear", "MonthNumber")
    # Months come in order, so an index's years are counted where the year changes: no distinct count.
    starts = F.col("TradingYear").isNotNull() & ~F.lag("TradingYear").over(w).eqNullSafe(F.col("TradingYear"))
    m = m.withColumns({"_prev": F.lag("AvgMonthlyClose").over(w), "_starts": starts.cast("bigint")})
    ret = (F.col("AvgMonthlyClose") - F.col("_prev")) * F.lit(100.0) / F.nullif(F.col("_prev"), F.lit(0.0))
    return (m.groupBy("Index")
            .agg(F.sum("_starts").alias("Number_of_Years"),
                 F.count("AvgMonthlyClose").alias("Total_Months"),
                 F.avg(ret).alias("Average_Monthly_Return"),
                 F.max("AvgMonthlyClose").alias("Highest_Monthly_Average"),
                 F.min("AvgMonthlyClose").alias("Lowest_Monthly_Average"))
            .orderBy("Index"))


V4_COLUMNS = ["Yearr", "Monthh", "Ticker", "IndexName", "TradingDays", "AverageClosePrice",
              "HighestClosePrice", "LowestClosePrice", "AverageDailyRange", "MonthNumber"]


def v4_monthly_performance(bars: DataFrame) -> DataFrame:
    return (bars.groupBy(year_of().alias("Yearr"), month_of().alias("MonthNumber"),
                         month_name().alias("Monthh"), "Ticker", "IndexName")
            .agg(F.count(F.lit(1)).alias("TradingDays"),
                 exact_avg("ClosePrice").alias("AverageClosePrice"),
                 F.max("ClosePrice").alias("HighestClosePrice"),
                 F.min("ClosePrice").alias("LowestClosePrice"),
                 exact_avg(_range()).alias("AverageDailyRange"))
            .select(*V4_COLUMNS))


def v5_yearly_performance(bars: DataFrame) -> DataFrame:
    return (bars.groupBy(year_of().alias("Yearr"), "Ticker", "IndexName")
            .agg(F.count(F.lit(1)).alias("TradingDays"),
                 exact_avg("ClosePrice").alias("AverageClosePrice"),
                 F.max("ClosePrice").alias("HighestClosePrice"),
                 F.min("ClosePrice").alias("LowestClosePrice"),
                 exact_avg(_range()).alias("AverageDailyRange"),
                 F.max("HighPrice").alias("HighestHighPrice"),
                 F.min("LowPrice").alias("LowestLowPrice")))


def p5_monthly_performance(bars: DataFrame, year: int) -> DataFrame:
    """v4 for one year. The date range is stated on TradeDate so it reaches the
    parquet scan (a filter on year(TradeDate) alone would not); where the bars have
    their Year column, it prunes year folders too."""
    b = between_dates(bars, _dt.date(year, 1, 1), _dt.date(year, 12, 31))
    return (v4_monthly_performance(b).filter(F.col("Yearr") == year)
            .select("Yearr", "Monthh", "MonthNumber", "Ticker", "IndexName", "TradingDays",
                    "AverageClosePrice", "HighestClosePrice", "LowestClosePrice", "AverageDailyRange")
            .orderBy("MonthNumber", "Monthh", "Ticker"))
