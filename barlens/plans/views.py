"""SQL surface: the bar table and the six views as session views (S11), and a
preview helper (S10).

``register_views(spark, bars)`` lets users keep writing SQL against the names the
reference used, e.g. ``spark.sql("SELECT * FROM vw_MarketSummary")``; each view
is the DataFrame function's plan, so Catalyst optimises through it (a ticker
filter on vw_DailyPerformance still reaches the parquet scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.operators import calendar, procedures, returns, rolling, summary
from barlens.schema import BAR_COLUMNS

VIEWS = {
    "vw_DailyPerformance": returns.v1_daily_performance,
    "vw_MovingAverages": rolling.v2_moving_averages,
    "vw_RunningMetrics": rolling.v3_running_metrics,
    "vw_MonthlyPerformance": calendar.v4_monthly_performance,
    "vw_YearlyPerformance": calendar.v5_yearly_performance,
    "vw_MarketSummary": summary.v6_market_summary,
}


def register_views(spark: SparkSession, bars: DataFrame, table_name: str = "GlobalIndexPrices") -> list[str]:
    """Register the bar table and the six views as temporary views; returns their names."""
    bars.createOrReplaceTempView(table_name)
    for name, fn in VIEWS.items():
        fn(bars).createOrReplaceTempView(name)
    return [table_name, *VIEWS]


_BAR_TYPES = ("TradeDate DATE, Ticker STRING, IndexName STRING, OpenPrice DECIMAL(18,4), "
              "HighPrice DECIMAL(18,4), LowPrice DECIMAL(18,4), ClosePrice DECIMAL(18,4), Volume BIGINT")


def register_procedures(spark: SparkSession, bars: DataFrame) -> list[str]:
    """The six procedures as SQL table functions, e.g.
    ``SELECT * FROM sp_GetMarketHistory('2-HIGH') ORDER BY TradeDate``.

    Each body is a plain SELECT over the views registered from the DataFrame
    functions (``register_views``), so the logic lives in one place. A table
    function's output has no order: add ORDER BY in the calling query."""
    register_views(spark, bars)
    procedures.p3_latest_snapshot(bars).createOrReplaceTempView("vw_LatestSnapshot")
    cols = ", ".join(BAR_COLUMNS)
    monthly = ("Yearr INT, Monthh STRING, MonthNumber INT, Ticker STRING, IndexName STRING, TradingDays BIGINT, "
               "AverageClosePrice DOUBLE, HighestClosePrice DECIMAL(18,4), LowestClosePrice DECIMAL(18,4), "
               "AverageDailyRange DOUBLE")
    summ = ", ".join(f"{c} {t}" for c, t in summary.v6_market_summary(bars).dtypes).replace("decimal", "DECIMAL")
    defs = {
        "sp_GetMarketHistory": ("p_ticker STRING", _BAR_TYPES,
                                f"SELECT {cols} FROM GlobalIndexPrices WHERE Ticker = p_ticker"),
        "sp_GetMarketByDateRange": ("p_start DATE, p_end DATE", _BAR_TYPES,
                                    f"SELECT {cols} FROM GlobalIndexPrices WHERE TradeDate BETWEEN p_start AND p_end"),
        "sp_GetLatestMarketSnapshot": ("", _BAR_TYPES, f"SELECT {cols} FROM vw_LatestSnapshot"),
        "sp_GetTopPerformingMarkets": ("p_n INT", "TradeDate DATE, Ticker STRING, IndexName STRING, "
                                       "ClosePrice DECIMAL(18,4)",
                                       "SELECT TradeDate, Ticker, IndexName, ClosePrice FROM ("
                                       "SELECT *, row_number() OVER (ORDER BY ClosePrice DESC, Ticker) AS _rn "
                                       "FROM vw_LatestSnapshot) WHERE _rn <= p_n"),
        "sp_GetMonthlyPerformance": ("p_year INT", monthly,
                                     "SELECT Yearr, Monthh, MonthNumber, Ticker, IndexName, TradingDays, "
                                     "AverageClosePrice, HighestClosePrice, LowestClosePrice, AverageDailyRange "
                                     "FROM vw_MonthlyPerformance WHERE Yearr = p_year"),
        "sp_GetExecutiveSummary": ("", summ, "SELECT * FROM vw_MarketSummary"),
    }
    for name, (params, returns_, body) in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE ({returns_}) "
                  f"RETURN {body}")
    return list(defs)


def preview(df: DataFrame, n: int = 100, order: list[str] | None = None, last: bool = False) -> DataFrame:
    """First (or last) ``n`` rows in an explicit order; ``TOP 100 *`` without an
    order picks arbitrary rows, so an order is always applied (default: all columns)."""
    cols = order or df.columns
    keys = [F.col(c).desc() if last else F.col(c).asc() for c in cols]
    return df.orderBy(*keys).limit(n)
