"""Calendar rollups from a stored table of mergeable month states.

A state is one row a (ticker, index name, year, month): row and value counts, exact sums, least and
greatest values, first and last close, and the days traded as a bit mask. Each part
merges by an associative aggregate (sum, min, max, min_by, max_by, bit_or), so any coarser rollup
(market, quarter, year, a range of whole months) is an aggregate of states, equal to
the same aggregate of rows.

The table lies in (Year, MonthNumber) folders. An append touches the months of its batch: they are
computed again from the stored bars, whose year folders it prunes, and replace the old folders in
one write. A repeated or late batch, or one whose writer died between the two writes,
gives the same table when it is refreshed again.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.functions.dates import month_of, year_of
from barlens.operators import ingest
from barlens.operators.calendar import V4_COLUMNS, _growth
from barlens.operators.measures import slice_bars
from barlens.schema import BAR_COLUMNS, PRICE_SUM
from barlens.sources.files import read_bars, write_bars, write_once

KEY = ["Ticker", "IndexName", "Year", "MonthNumber"]
# Folders of a month hold at most as many files.
MONTH_BUCKETS = 2

# Part -> the aggregate that merges it.
PARTS = {"Days": F.sum, "CloseSum": F.sum, "CloseCount": F.sum, "CloseMax": F.max, "CloseMin": F.min, "HighMax": F.max,
         "LowMin": F.min, "RangeSum": F.sum, "RangeCount": F.sum, "TradedSum": F.sum, "TradedCount": F.sum,
         "TradedMin": F.min, "VolumeMax": F.max, "VolumeSum": F.sum, "First": F.min, "Last": F.max, "DayMask": F.bit_or}


def _of_rows() -> dict:
    """Part -> the aggregate of rows."""
    traded = F.when(F.col("Volume") > 0, F.col("Volume"))
    daily = F.col("HighPrice") - F.col("LowPrice")
    close = F.struct("TradeDate", "ClosePrice")
    return {
        "Days": F.count(F.lit(1)),
        "CloseSum": F.sum("ClosePrice").cast(PRICE_SUM), "CloseCount": F.count("ClosePrice"),
        "CloseMax": F.max("ClosePrice"), "CloseMin": F.min("ClosePrice"), "HighMax": F.max("HighPrice"), "LowMin": F.min("LowPrice"),
        "RangeSum": F.sum(daily).cast(PRICE_SUM), "RangeCount": F.count(daily),
        "TradedSum": F.sum(traded), "TradedCount": F.count(traded), "TradedMin": F.min(traded),
        "VolumeMax": F.max("Volume"), "VolumeSum": F.sum("Volume"), "First": F.min(close), "Last": F.max(close),
        # Days of the month that have a row, bits 1 to 31: the masks of several series merge into one.
        "DayMask": F.bit_or(F.expr("shiftleft(1L, day(TradeDate))")),
    }


def month_state(bars: DataFrame) -> DataFrame:
    """One row a (ticker, index name, year, month) of ``bars``."""
    return bars.groupBy("Ticker", "IndexName", year_of().alias("Year"), month_of().alias("MonthNumber")) \
        .agg(*[part.alias(name) for name, part in _of_rows().items()])


def merged(state: DataFrame, *keys) -> DataFrame:
    """States by coarser keys (columns of the state, or aliased expressions of them)."""
    return state.groupBy(*keys).agg(*[merge(name).alias(name) for name, merge in PARTS.items()])


# ------------------------------------------------------------------ the stored table
def refresh(bars: DataFrame, path: str, months: list[tuple[int, int]] | None = None) -> None:
    """Write the states of ``months`` (default: all) of stored ``bars`` (with their Year column) in place of the old ones."""
    if months is not None:
        if not months:
            return
        wanted = F.lit(False)
        for y in sorted({y for y, _ in months}):
            in_year = sorted(m for of, m in months if of == y)
            wanted = wanted | ((F.col("Year") == y) & F.month("TradeDate").isin(in_year))
        # The years on their own, so that folders are pruned before a row is read.
        bars = bars.where(F.col("Year").isin(sorted({y for y, _ in months}))).where(wanted)
    state = month_state(bars.select(*BAR_COLUMNS))
    dealt = state.repartition("Year", "MonthNumber", F.pmod(F.hash("Ticker"), F.lit(MONTH_BUCKETS)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Year", "MonthNumber").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append(spark: SparkSession, batch: DataFrame, bars_path: str, state_path: str) -> None:
    """Append the rows of ``batch`` with unknown keys to the bars, then bring the states of its months up to date."""
    batch = write_once(batch.select(*BAR_COLUMNS), "batch")
    # At most twelve a calendar year of the batch.
    months = [tuple(r) for r in batch.select(year_of(), month_of()).distinct().collect()]
    if not months:
        return
    stored = read_bars(spark, bars_path, extra=["Year"]) if _exists(spark, bars_path) else None
    fresh = batch.dropDuplicates(ingest.KEY) if stored is None else ingest.new_keys(
        batch, stored.where(F.col("Year").isin(sorted({y for y, _ in months}))))
    write_bars(fresh, bars_path)
    refresh(read_bars(spark, bars_path, extra=["Year"]), state_path, months)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


# ---------------------------------------------------------------------- rollups
def _avg(part: str) -> Column:
    return F.col(f"{part}Sum").cast("double") / F.nullif(F.col(f"{part}Count"), F.lit(0))


def _int_avg(part: str) -> Column:
    return F.call_function("div", F.col(f"{part}Sum"), F.nullif(F.col(f"{part}Count"), F.lit(0)))


def _month_name(column: str = "MonthNumber") -> Column:
    return F.date_format(F.make_date(F.lit(2000), F.col(column), F.lit(1)), "MMMM")


def v4_monthly_performance(state: DataFrame) -> DataFrame:
    return state.select(
        F.col("Year").alias("Yearr"), _month_name().alias("Monthh"), "Ticker", "IndexName", F.col("Days").alias("TradingDays"),
        _avg("Close").alias("AverageClosePrice"), F.col("CloseMax").alias("HighestClosePrice"),
        F.col("CloseMin").alias("LowestClosePrice"), _avg("Range").alias("AverageDailyRange"), "MonthNumber").select(*V4_COLUMNS)


def v5_yearly_performance(state: DataFrame) -> DataFrame:
    return merged(state, F.col("Year").alias("Yearr"), "Ticker", "IndexName").select(
        "Yearr", "Ticker", "IndexName", F.col("Days").alias("TradingDays"), _avg("Close").alias("AverageClosePrice"),
        F.col("CloseMax").alias("HighestClosePrice"), F.col("CloseMin").alias("LowestClosePrice"),
        _avg("Range").alias("AverageDailyRange"), F.col("HighMax").alias("HighestHighPrice"), F.col("LowMin").alias("LowestLowPrice"))


def p5_monthly_performance(state: DataFrame, year: int) -> DataFrame:
    """v4 of one year, from its folders."""
    return v4_monthly_performance(state.where(F.col("Year") == year)).select(
        "Yearr", "Monthh", "MonthNumber", "Ticker", "IndexName", "TradingDays", "AverageClosePrice", "HighestClosePrice",
        "LowestClosePrice", "AverageDailyRange").orderBy("MonthNumber", "Monthh", "Ticker")


def q27_monthly(state: DataFrame) -> DataFrame:
    return merged(state, "IndexName", F.col("Year").alias("_Year"), "MonthNumber").select(
        "IndexName", "_Year", "MonthNumber", _month_name().alias("Month_Name"), F.col("Days").alias("TradingDays"),
        _avg("Close").alias("AverageClosingPrice"), F.col("CloseMax").alias("HighestClosingPrice"),
        F.col("CloseMin").alias("LowestClosingPrice"), _int_avg("Traded").alias("AverageVolume"), _avg("Range").alias("DailyAverage"))


def q28_quarterly(state: DataFrame) -> DataFrame:
    quarter = F.concat(F.lit("Q"), F.ceil(F.col("MonthNumber") / 3).cast("string")).alias("QuarterName")
    return merged(state, "IndexName", F.col("Year").alias("Yearr"), quarter).select(
        "IndexName", "Yearr", "QuarterName", F.col("Days").alias("TradingDays"), _avg("Close").alias("AverageClosingPrice"),
        F.col("CloseMax").alias("HighestClosingPrice"), F.col("CloseMin").alias("LowestClosingPrice"),
        _int_avg("Traded").alias("AverageVolume"))


def q29_yearly(state: DataFrame) -> DataFrame:
    return merged(state, "IndexName", F.col("Year").alias("Yeaar")).select(
        "IndexName", "Yeaar", F.col("Days").alias("TradingDays"), F.col("CloseMax").alias("HighestClosePrice"),
        F.col("CloseMin").alias("LowestClosePrice"), _avg("Close").alias("AverageClosingPrice"),
        _int_avg("Traded").alias("AverageVolume"), F.col("VolumeMax").alias("Highestvolume"),
        F.col("TradedMin").alias("LowestVolume")).orderBy("IndexName", "Yeaar")


def _with_previous(periods: DataFrame, value: str, previous: str, *order: str) -> DataFrame:
    return periods.withColumn(previous, F.lag(value).over(Window.partitionBy("IndexName").orderBy(*order)))


def q30_yoy_growth(state: DataFrame, percent: bool = False) -> DataFrame:
    """As written the growth is a fraction; ``percent`` gives the intended percentage."""
    y = merged(state, "IndexName", F.col("Year").alias("Yearr")).select("IndexName", "Yearr", _avg("Close").alias("CurrentAverageCp"))
    y = _with_previous(y, "CurrentAverageCp", "prevAverageCp", "Yearr")
    name, scale = ("YoY_Growth_Pct", 100.0) if percent else ("YoY_Growth", None)
    return y.select("*", (F.col("CurrentAverageCp") - F.col("prevAverageCp")).alias("YoYChange"),
                    _growth("CurrentAverageCp", "prevAverageCp", scale).alias(name)).orderBy("IndexName", "Yearr")


def q31_mom_growth(state: DataFrame) -> DataFrame:
    m = merged(state, "IndexName", F.col("Year").alias("Yearr"), F.col("MonthNumber").alias("mon")).select(
        "IndexName", "Yearr", _month_name("mon").alias("Month_Name"), "mon", _avg("Close").alias("AverageCloseprice"))
    m = _with_previous(m, "AverageCloseprice", "prevcp", "Yearr", "mon")
    return m.select("*", _growth("AverageCloseprice", "prevcp", 100.0).alias("MoM_Growth_Pct")).orderBy("IndexName", "Yearr", "mon")


# ----------------------------------------------------------------------- slicers
def split_range(start: _dt.date, end: _dt.date) -> tuple[list[tuple[_dt.date, _dt.date]], tuple[int, int] | None]:
    """(edge ranges of days, first and last whole month as year * 12 + month - 1, or None) of an inclusive range."""
    first = start.year * 12 + start.month - 1 + (start.day > 1)
    after = end + _dt.timedelta(days=1)
    last = after.year * 12 + after.month - 1 - 1
    if first > last:
        return [(start, end)], None
    day = lambda k: _dt.date(k // 12, k % 12 + 1, 1)
    edges = []
    if start < day(first):
        edges.append((start, day(first) - _dt.timedelta(days=1)))
    if day(last + 1) <= end:
        edges.append((day(last + 1), end))
    return edges, (first, last)


def sliced_months(state: DataFrame, bars: DataFrame, markets: DataFrame, start: _dt.date, end: _dt.date,
                  tickers: list[str] | None = None, countries: list[str] | None = None) -> DataFrame:
    """States of a range of dates: whole months from the stored states, only the edge days (at most two months) from rows."""
    edges, whole = split_range(start, end)
    parts = []
    if whole:
        month = F.col("Year") * 12 + F.col("MonthNumber") - 1
        inside = state.where(F.col("Year").between(whole[0] // 12, whole[1] // 12)).where(month.between(*whole))
        parts.append(slice_bars(inside, markets, tickers, countries))
    for lo, hi in edges:
        parts.append(month_state(slice_bars(bars, markets, tickers, countries, lo, hi).select(*BAR_COLUMNS)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def d01_kpis(state: DataFrame, markets: DataFrame) -> DataFrame:
    """The KPI row. Trading days are bits of the months' merged masks: they add up exactly, no date is shuffled."""
    s = state.join(markets.select("Ticker", "Country"), "Ticker", "left")
    by_month = merged(s, "Country", "Year", "MonthNumber")
    months = by_month.groupBy("Year", "MonthNumber").agg(
        F.bit_count(F.bit_or("DayMask")).alias("_days"), F.collect_set("Country").alias("_countries"),
        *[PARTS[p](p).alias(p) for p in ("CloseMax", "CloseMin", "CloseSum", "CloseCount", "VolumeSum")])
    return months.agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("_countries")))).cast("bigint").alias("Total_Countries"),
        F.coalesce(F.sum("_days"), F.lit(0)).cast("bigint").alias("Trading_Days"),
        F.max("CloseMax").alias("Highest_Index_Level"), F.min("CloseMin").alias("Lowest_Index_Level"),
        (F.sum("CloseSum").cast("double") / F.nullif(F.sum("CloseCount"), F.lit(0))).alias("Average_Index_Level"),
        F.sum("VolumeSum").alias("Total_Volume"))


def d02_market_trend(state: DataFrame) -> DataFrame:
    return state.select("Ticker", "IndexName", "Year", "MonthNumber", _avg("Close").alias("Average_Close"))


def d04_volume_trend(state: DataFrame) -> DataFrame:
    return state.select("Ticker", "IndexName", "Year", "MonthNumber", F.col("VolumeSum").alias("Total_Volume"))


def d21_slicer(state: DataFrame, bars: DataFrame, markets: DataFrame, start: _dt.date, end: _dt.date, **slicer) -> DataFrame:
    """The KPI row of a sliced range."""
    return d01_kpis(sliced_months(state, bars, markets, start, end, **slicer), markets)
