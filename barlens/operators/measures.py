"""Report measures (d01-d21).

The reference names these measures but ships no formula (its report file is not
in the tree), so every definition here is ours and is stated in its docstring.
``r`` is the daily return close / previous close - 1 (per ticker); "latest" is a
ticker's last trading date.

Most measures read one per-market table (``market_table``): the per-row returns,
20-row volatility and year-to-date return are computed once with series windows,
then one grouped aggregate (partial + final, so a large ticker collapses map-side)
gives one row per market. Measures that rank markets (d03, d10, d14, d16-d18) write
that table once, when they are built, and read it from there; the rankings
(percent_rank, ntile, rank) are dealt to value ranges (``ranking``): no task gets
all markets.

Measures of the market table take the slicers of d21 (``slicer=``): tickers and
countries cut before the series windows, dates after them, so the first return of
a slice still has its previous close and YTD its first close of the year.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.dates import month_of, quarter_of, year_of
from barlens.functions.numeric import exact_avg, safe_div, to_double
from barlens.operators.procedures import between_dates
from barlens.operators.ranking import with_percent_ranks, with_rank, with_row_number
from barlens.operators.windows import with_block_stddev, with_frames, with_frames_between, with_lag
from barlens.sources.bars import date_columns
from barlens.sources.files import write_once

# Fixed default weights of the composite score: returns, (low) volatility,
# liquidity, trading activity.
COMPOSITE_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
LIQUIDITY_LABELS = {1: "High", 2: "Medium", 3: "Low"}


def _pos():
    return F.when(F.col("Volume") > 0, F.col("Volume"))


# ------------------------------------------------------------------ building blocks
def _returns_and_volatility(d: DataFrame, w) -> DataFrame:
    """Within one series window: r from the previous close, then stddev_samp of r
    over the last 20 rows (needs the 20 preceding rows in all)."""
    d = d.withColumn("_prev", F.lag("ClosePrice").over(w))
    d = d.withColumn("Daily_Return", safe_div("ClosePrice", "_prev") - F.lit(1.0))
    return d.withColumn("Rolling_Volatility_20",
                        F.stddev_samp("Daily_Return").over(w.rowsBetween(-19, 0))).drop("_prev")


def with_ytd(df: DataFrame) -> DataFrame:
    """Adds YTD_Return = close / first close of the ticker's calendar year - 1.

    The window is partitioned by (ticker, year): no partition exceeds one year."""
    w = Window.partitionBy("Ticker", F.year("TradeDate")).orderBy("TradeDate")
    return df.withColumn("YTD_Return", safe_div(F.col("ClosePrice"), F.first("ClosePrice").over(w)) - F.lit(1.0))


def series_metrics(bars: DataFrame, strategy=None) -> DataFrame:
    """Per row: Daily_Return, Rolling_Volatility_20, YTD_Return (one series pass + one
    (ticker, year) window)."""
    d = with_frames(bars, "Ticker", "TradeDate", 20, _returns_and_volatility, strategy=strategy)
    return with_ytd(d)


def market_table(bars: DataFrame, strategy=None, slicer: dict | None = None,
                 markets: DataFrame | None = None) -> DataFrame:
    """One row per market: latest YTD return and 20-row volatility, return statistics,
    volume statistics and the share of days with volume."""
    chosen = dict(slicer or {})
    start, end = chosen.pop("start", None), chosen.pop("end", None)
    d = series_metrics(slice_bars(bars, markets, end=end, **chosen), strategy)
    if start is not None:
        d = d.filter(F.col("TradeDate") >= F.lit(start))
    return d.groupBy("Ticker", "IndexName").agg(
        F.max_by("YTD_Return", "TradeDate").alias("YTD_Return"),
        F.max_by("Rolling_Volatility_20", "TradeDate").alias("Volatility_20"),
        F.avg("Daily_Return").alias("Average_Return"),
        F.stddev_samp("Daily_Return").alias("Return_StdDev"),
        F.min("Daily_Return").alias("Min_Return"),
        F.max("Daily_Return").alias("Max_Return"),
        (F.sum(_pos()).cast("double") / F.nullif(F.count(_pos()), F.lit(0))).alias("Average_Volume"),
        F.max(_pos()).alias("Highest_Volume"),
        F.min(_pos()).alias("Lowest_Volume"),
        (F.count(_pos()).cast("double") / F.count(F.lit(1))).alias("Active_Share"),
        F.sum("Volume").alias("Total_Volume"))


def slice_bars(bars: DataFrame, markets: DataFrame | None = None, tickers: list[str] | None = None,
               countries: list[str] | None = None, start: _dt.date | None = None,
               end: _dt.date | None = None) -> DataFrame:
    """d21 Dynamic slicers: optional tickers, countries and an inclusive date range,
    applied before any measure. Ticker and date filters reach the parquet scan; the
    country filter is a semi-join with the market dimension."""
    b = between_dates(bars, start, end)
    if tickers:
        b = b.filter(F.col("Ticker").isin(list(tickers)))
    if countries:
        keep = markets.filter(F.col("Country").isin(list(countries))).select("Ticker")
        b = b.join(keep, "Ticker", "left_semi")
    return b


# ------------------------------------------------------------------------- measures
def d01_kpis(bars: DataFrame, markets: DataFrame) -> DataFrame:
    """Total Countries, Trading Days, Highest/Lowest/Average Index Level, Total Volume.

    Rows are aggregated to (country, month) first, with the days that have a row as bits of one
    number: masks of the countries merge by OR, and a month's distinct days are its bits. No
    date is shuffled or expanded for the distinct count."""
    b = bars.join(markets.select("Ticker", "Country"), "Ticker", "left")
    months = b.groupBy("Country", year_of().alias("_y"), month_of().alias("_m")).agg(
        F.bit_or(F.expr("shiftleft(1L, day(TradeDate))")).alias("_days"),
        F.max("ClosePrice").alias("_high"), F.min("ClosePrice").alias("_low"), F.sum("ClosePrice").alias("_sum"),
        F.count("ClosePrice").alias("_n"), F.sum("Volume").alias("_volume"))
    merged = months.groupBy("_y", "_m").agg(
        F.bit_count(F.bit_or("_days")).alias("_days"), F.collect_set("Country").alias("_countries"),
        F.max("_high").alias("_high"), F.min("_low").alias("_low"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"),
        F.sum("_volume").alias("_volume"))
    return merged.agg(F.size(F.array_distinct(F.flatten(F.collect_set("_countries")))).cast("bigint").alias("Total_Countries"),
                      F.coalesce(F.sum("_days"), F.lit(0)).cast("bigint").alias("Trading_Days"),
                      F.max("_high").alias("Highest_Index_Level"),
                      F.min("_low").alias("Lowest_Index_Level"),
                      (F.sum("_sum").cast("double") / F.nullif(F.sum("_n"), F.lit(0))).alias("Average_Index_Level"),
                      F.sum("_volume").alias("Total_Volume"))


def d02_market_trend(bars: DataFrame) -> DataFrame:
    """Average close per market and month."""
    return bars.groupBy("Ticker", "IndexName", year_of().alias("Year"), month_of().alias("MonthNumber")) \
        .agg(exact_avg("ClosePrice").alias("Average_Close"))


def _flag_rows(mt: DataFrame, flags: list[tuple[str, F.Column]]) -> DataFrame:
    """One output row per (market, flag that holds): no union, one pass."""
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in flags])
    return mt.withColumn("Category", F.explode(F.filter(arr, lambda x: x.isNotNull())))


def d03_best_worst(bars: DataFrame, strategy=None, **sliced) -> DataFrame:
    """Best and worst market by latest YTD return (ties kept): those equal to the
    greatest and the least, two numbers."""
    mt = write_once(market_table(bars, strategy, **sliced).select("Ticker", "IndexName", "YTD_Return"), "markets")
    ends = mt.agg(F.max("YTD_Return"), F.min("YTD_Return")).first()
    top, low = (F.col("YTD_Return") == F.lit(v).cast("double") for v in ends)
    out = _flag_rows(mt.filter(top | low), [("Best", top), ("Worst", low)])
    return out.select("Category", "Ticker", "IndexName", "YTD_Return")


def d04_volume_trend(bars: DataFrame) -> DataFrame:
    """Total volume per market and month."""
    return bars.groupBy("Ticker", "IndexName", year_of().alias("Year"), month_of().alias("MonthNumber")) \
        .agg(F.sum("Volume").alias("Total_Volume"))


def d05_regional(bars: DataFrame, markets: DataFrame, strategy=None, slicer: dict | None = None) -> DataFrame:
    """Per country (NULL for markets that the dimension does not have): markets,
    average of the markets' latest YTD return, total volume."""
    mt = market_table(bars, strategy, slicer, markets).join(markets.select("Ticker", "Country"), "Ticker", "left")
    return mt.groupBy("Country").agg(F.count(F.lit(1)).alias("Markets"),
                                     F.avg("YTD_Return").alias("Average_YTD_Return"),
                                     F.sum("Total_Volume").alias("Total_Volume"))


def d06_ytd_return(bars: DataFrame) -> DataFrame:
    """Per row: close / first close of the ticker's calendar year - 1."""
    return with_ytd(bars).select("TradeDate", "Ticker", "IndexName", "ClosePrice", "YTD_Return")


def d07_breadth(bars: DataFrame, strategy=None) -> DataFrame:
    """Per date: markets up, markets down, and up / (up + down)."""
    d = with_lag(bars, "Ticker", "TradeDate", "ClosePrice", "_prev", strategy=strategy)
    g = d.groupBy("TradeDate").agg(
        F.sum(F.when(F.col("ClosePrice") > F.col("_prev"), 1).otherwise(0)).alias("Risers"),
        F.sum(F.when(F.col("ClosePrice") < F.col("_prev"), 1).otherwise(0)).alias("Fallers"))
    return g.withColumn("Breadth_Ratio", safe_div("Risers", F.col("Risers") + F.col("Fallers")))


def d08_volume_kpis(bars: DataFrame) -> DataFrame:
    """Average, highest and lowest volume per market over days with volume."""
    pos = _pos()
    return bars.groupBy("Ticker", "IndexName").agg(
        (F.sum(pos).cast("double") / F.nullif(F.count(pos), F.lit(0))).alias("Average_Volume"),
        F.max(pos).alias("Highest_Volume"), F.min(pos).alias("Lowest_Volume"))


def d09_volume_share(bars: DataFrame) -> DataFrame:
    """Each market's share of the total volume of all markets."""
    v = bars.groupBy("Ticker", "IndexName").agg(F.sum("Volume").alias("Total_Volume"))
    total = bars.agg(F.sum("Volume")).scalar()
    return v.withColumn("Volume_Share", safe_div(F.col("Total_Volume"), total))


def d10_liquidity(bars: DataFrame) -> DataFrame:
    """Liquidity rating: terciles of average volume (days with volume), High to Low."""
    v = write_once(d08_volume_kpis(bars), "volumes")
    order = [F.col("Average_Volume").isNull(), -F.col("Average_Volume"), F.col("Ticker"), F.col("IndexName")]
    v, n = with_row_number(v, order, "_place")
    # NTILE(3): the first n mod 3 tiers have one row more.
    short, more = divmod(n, 3)
    long = (short + 1) * more
    tier = F.when(F.col("_place") <= long, F.ceil(F.col("_place") / (short + 1))).otherwise(
        more + F.ceil((F.col("_place") - long) / max(short, 1)))
    v = v.withColumn("Liquidity_Tier", tier.cast("int"))
    label = F.when(F.col("Liquidity_Tier") == 1, LIQUIDITY_LABELS[1]) \
        .when(F.col("Liquidity_Tier") == 2, LIQUIDITY_LABELS[2]).otherwise(LIQUIDITY_LABELS[3])
    return v.select("Ticker", "IndexName", "Average_Volume", "Liquidity_Tier", label.alias("Liquidity_Rating"))


def rolling_volatility(bars: DataFrame, rows: int) -> DataFrame:
    """d11 for long frames: the same columns over the last ``rows`` rows, at a cost per row that they don't change."""
    d = with_lag(bars, "Ticker", "TradeDate", "ClosePrice", "_prev")
    d = d.withColumn("Daily_Return", safe_div("ClosePrice", "_prev") - F.lit(1.0))
    d = with_block_stddev(d, "Ticker", "TradeDate", "Daily_Return", rows, "Rolling_Volatility")
    return d.select("TradeDate", "Ticker", "IndexName", "Daily_Return", "Rolling_Volatility")


def d11_rolling_vol20(bars: DataFrame, strategy=None, start=None, end=None) -> DataFrame:
    """Per row: r and the sample standard deviation of r over the last 20 rows (not annualised).

    With ``start``/``end`` only those dates, from the rows in the range and 20 before it."""
    if start is None and end is None:
        d = with_frames(bars, "Ticker", "TradeDate", 20, _returns_and_volatility, strategy=strategy)
    else:
        d = with_frames_between(bars, "Ticker", "TradeDate", 20, _returns_and_volatility, start, end)
    return d.select("TradeDate", "Ticker", "IndexName", "Daily_Return", "Rolling_Volatility_20")


def d12_volatility_by_country(bars: DataFrame, markets: DataFrame, strategy=None,
                              slicer: dict | None = None) -> DataFrame:
    """Per country (NULL for markets that the dimension does not have): markets, mean
    and highest of the markets' latest 20-row volatility."""
    mt = market_table(bars, strategy, slicer, markets).join(markets.select("Ticker", "Country"), "Ticker", "left")
    return mt.groupBy("Country").agg(F.count(F.lit(1)).alias("Markets"),
                                     F.avg("Volatility_20").alias("Average_Volatility_20"),
                                     F.max("Volatility_20").alias("Highest_Volatility_20"))


def d13_risk_table(bars: DataFrame, strategy=None, **sliced) -> DataFrame:
    """Per market: mean, standard deviation, min and max of r, latest 20-row volatility."""
    return market_table(bars, strategy, **sliced).select("Ticker", "IndexName", "Average_Return", "Return_StdDev",
                                               "Min_Return", "Max_Return", "Volatility_20")


def _percent_ranks(mt: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Ticker, IndexName and several columns, with their percent ranks among markets (NULLs first) in one go."""
    return with_percent_ranks(write_once(mt.select("Ticker", "IndexName", *columns.values()), "markets"), columns)


def d14_risk_score(bars: DataFrame, strategy=None, **sliced) -> DataFrame:
    """Risk score 0-100: percent rank of the latest 20-row volatility among markets."""
    mt = _percent_ranks(market_table(bars, strategy, **sliced), {"_risk": "Volatility_20"})
    return mt.select("Ticker", "IndexName", "Volatility_20", (F.lit(100.0) * F.col("_risk")).alias("Risk_Score"))


def d15_volume_growth(bars: DataFrame) -> DataFrame:
    """Monthly volume against the market's previous month, in percent."""
    m = bars.groupBy("Ticker", "IndexName", year_of().alias("Year"), month_of().alias("MonthNumber")) \
        .agg(F.sum("Volume").alias("Monthly_Volume"))
    w = Window.partitionBy("Ticker").orderBy("Year", "MonthNumber")
    m = m.withColumn("Previous_Volume", F.lag("Monthly_Volume").over(w))
    growth = to_double(F.col("Monthly_Volume") - F.col("Previous_Volume")) \
        / F.nullif(to_double("Previous_Volume"), F.lit(0.0)) * F.lit(100.0)
    return m.withColumn("Volume_Growth_Pct", growth)


def _scored(bars: DataFrame, weights: tuple, strategy=None, **sliced) -> DataFrame:
    """The market table with composite and risk score."""
    mt = _percent_ranks(market_table(bars, strategy, **sliced),
                        {"_ytd": "YTD_Return", "_risk": "Volatility_20", "_volume": "Average_Volume",
                         "_active": "Active_Share"})
    w1, w2, w3, w4 = weights
    score = F.lit(100.0) * (F.lit(w1) * F.col("_ytd") + F.lit(w2) * (F.lit(1.0) - F.col("_risk"))
                            + F.lit(w3) * F.col("_volume") + F.lit(w4) * F.col("_active"))
    return mt.withColumn("Composite_Score", score).withColumn("Risk_Score", F.lit(100.0) * F.col("_risk"))


def d16_composite(bars: DataFrame, weights: tuple = COMPOSITE_WEIGHTS, strategy=None, **sliced) -> DataFrame:
    """Composite score 0-100 from percent ranks among markets:
    w1 * pr(YTD return) + w2 * (1 - pr(volatility)) + w3 * pr(average volume)
    + w4 * pr(share of days with volume)."""
    return _scored(bars, weights, strategy, **sliced).select(
        "Ticker", "IndexName", "YTD_Return", "Volatility_20", "Average_Volume", "Active_Share", "Composite_Score")


def d17_ranking(bars: DataFrame, weights: tuple = COMPOSITE_WEIGHTS, strategy=None, **sliced) -> DataFrame:
    """Rank of markets by composite score (ties share a rank)."""
    c = write_once(d16_composite(bars, weights, strategy, **sliced).select("Ticker", "IndexName", "Composite_Score"), "scores")
    return with_rank(c, "Composite_Score", "Market_Rank").select(
        "Ticker", "IndexName", "Composite_Score", "Market_Rank")


_INSIGHTS = [  # (type, metric column, True = highest wins)
    ("Best performer", "YTD_Return", True),
    ("Worst performer", "YTD_Return", False),
    ("Highest risk", "Risk_Score", True),
    ("Lowest risk", "Risk_Score", False),
    ("Most liquid", "Average_Volume", True),
    ("Top ranked", "Composite_Score", True),
]


def d18_insights(bars: DataFrame, strategy=None, **sliced) -> DataFrame:
    """One sentence per insight, from the top or bottom market of a measure.

    All insights come from one global aggregate of ``min_by`` over the per-market
    table (partial aggregation, no sort, no union); ties go to the first ticker.
    """
    mt = _scored(bars, COMPOSITE_WEIGHTS, strategy, **sliced)
    picks = []
    for i, (_, col, high) in enumerate(_INSIGHTS):
        key = F.when(F.col(col).isNotNull(),
                     F.struct((-F.col(col) if high else F.col(col)).alias("k"), F.col("Ticker").alias("t")))
        picks.append(F.min_by(F.struct("Ticker", "IndexName", F.col(col).cast("double").alias("v")), key)
                     .alias(f"_i{i}"))
    one = mt.agg(*picks)
    rows = F.array(*[F.struct(F.lit(name).alias("Insight_Type"), F.col(f"_i{i}").alias("p"))
                     for i, (name, _, _) in enumerate(_INSIGHTS)])
    x = one.select(F.explode(rows).alias("x")).filter(F.col("x.p").isNotNull())
    return x.select(F.col("x.Insight_Type").alias("Insight_Type"), F.col("x.p.Ticker").alias("Ticker"),
                    F.col("x.p.IndexName").alias("IndexName"), F.col("x.p.v").alias("Metric_Value"),
                    F.format_string("%s: %s (%s)", F.col("x.Insight_Type"), F.col("x.p.Ticker"),
                                    F.col("x.p.IndexName")).alias("Insight"))


def d19_drilldown(bars: DataFrame) -> DataFrame:
    """Drill-down: ROLLUP(Ticker, Year, Quarter, Month) with the grouping level.

    Rows are summed to months once. Quarters and years are sums over sorted months, given out with their first month, so
    a task holds no more groups than months; only the markets' totals are expanded. Averages divide last."""
    keys, sums = ["Ticker", "Year", "Quarter", "MonthNumber"], ["_days", "_sum", "_n", "_volume"]
    months = bars.groupBy("Ticker", year_of().alias("Year"), quarter_of().alias("Quarter"),
                          month_of().alias("MonthNumber")).agg(
        F.count(F.lit(1)).alias("_days"), F.sum("ClosePrice").alias("_sum"), F.count("ClosePrice").alias("_n"),
        F.sum("Volume").alias("_volume"))
    rows = months.repartition("Ticker", "Year")
    for name, n in (("quarter", 3), ("year", 2)):
        # One sort serves both: the longer keys come first.
        w = Window.partitionBy(*keys[:n]).orderBy(*keys[n:])
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({f"_{name}": F.row_number().over(w) == 1, **{f"{name}{c}": F.sum(c).over(whole) for c in sums}})
    none = F.lit(None).cast("int")
    row = lambda n, keep, of: [keep, *keys[:n], *[none] * (4 - n), F.lit(2 ** (4 - n) - 1),
                             *[F.col(of + c).cast("double") if c == "_sum" else of + c for c in sums]]
    parts = rows.select(F.stack(F.lit(3), *row(4, F.lit(True), ""), *row(3, F.col("_quarter"), "quarter"),
                                *row(2, F.col("_year"), "year")).alias("_keep", *keys, "Grouping_Level", *sums)).where("_keep")
    markets = months.groupBy("Ticker").agg(*[F.sum(c).alias(c) for c in sums])
    totals = markets.rollup("Ticker").agg((F.grouping("Ticker").cast("int") * 8 + 7).alias("Grouping_Level"),
                                          *[F.sum(c).alias(c) for c in sums])
    totals = totals.withColumns({"_sum": F.col("_sum").cast("double"), **{c: none for c in keys[1:]}})
    both = parts.drop("_keep").unionByName(totals)
    return both.select(*keys, "Grouping_Level", F.col("_days").alias("Trading_Days"),
                       (F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))).alias("Average_Close"),
                       F.col("_volume").alias("Total_Volume"))


def d20_star(bars: DataFrame, markets: DataFrame) -> DataFrame:
    """Fact rows joined to the market dimension, with the date dimension's columns.

    The date dimension is a function of the date, so its columns are computed on the
    fact rows: no second scan for the distinct dates and no join."""
    f = bars.select("TradeDate", "Ticker", "IndexName", "ClosePrice", "Volume") \
        .join(markets.select("Ticker", "Country"), "Ticker", "left")
    return f.select("TradeDate", "Ticker", "IndexName", "Country",
                    *date_columns(), "ClosePrice", "Volume")


def d21_slicer(bars: DataFrame, markets: DataFrame, **slicer) -> DataFrame:
    """The KPI row (d01) after the slicers."""
    return d01_kpis(slice_bars(bars, markets, **slicer), markets)
