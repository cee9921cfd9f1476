"""DuckDB oracle SQL for the report measures (d01-d21); definitions as in
``barlens.operators.measures``. ``arg_max_null`` keeps a NULL latest value, as
Spark's ``max_by`` does (DuckDB's ``max_by`` would skip it)."""

from __future__ import annotations

from barlens.plans.oracle_base import DIM_MARKET, sql

POS = "CASE WHEN Volume > 0 THEN Volume END"
YEAR = "CAST(year(TradeDate) AS INTEGER)"
MONTH = "CAST(month(TradeDate) AS INTEGER)"

SERIES = """r1 AS (SELECT *, lag(ClosePrice) OVER (PARTITION BY Ticker ORDER BY TradeDate) AS prev FROM bars),
r2 AS (SELECT *, CAST(ClosePrice AS DOUBLE) / NULLIF(CAST(prev AS DOUBLE), 0) - 1 AS Daily_Return FROM r1),
sm AS (SELECT *, stddev_samp(Daily_Return) OVER (PARTITION BY Ticker ORDER BY TradeDate
          ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS Rolling_Volatility_20,
        CAST(ClosePrice AS DOUBLE) / NULLIF(CAST(first_value(ClosePrice) OVER (PARTITION BY Ticker, year(TradeDate)
          ORDER BY TradeDate) AS DOUBLE), 0) - 1 AS YTD_Return FROM r2)"""

MT = SERIES + f""",
mt AS (SELECT Ticker, IndexName, arg_max_null(YTD_Return, TradeDate) AS YTD_Return,
        arg_max_null(Rolling_Volatility_20, TradeDate) AS Volatility_20,
        avg(Daily_Return) AS Average_Return, stddev_samp(Daily_Return) AS Return_StdDev,
        min(Daily_Return) AS Min_Return, max(Daily_Return) AS Max_Return,
        CAST(sum({POS}) AS DOUBLE) / NULLIF(count({POS}), 0) AS Average_Volume,
        max({POS}) AS Highest_Volume, min({POS}) AS Lowest_Volume,
        CAST(count({POS}) AS DOUBLE) / count(*) AS Active_Share, CAST(sum(Volume) AS BIGINT) AS Total_Volume
      FROM sm GROUP BY Ticker, IndexName)"""

SLICED = "Ticker IN (SELECT Ticker FROM dim_market WHERE Country IN ('ASIA')) " \
    "AND TradeDate BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"

_SCORES = """,
comp AS (SELECT Ticker, IndexName, YTD_Return, Volatility_20, Average_Volume, Active_Share,
        100.0 * (0.4 * percent_rank() OVER (ORDER BY YTD_Return ASC NULLS FIRST)
               + 0.3 * (1.0 - percent_rank() OVER (ORDER BY Volatility_20 ASC NULLS FIRST))
               + 0.2 * percent_rank() OVER (ORDER BY Average_Volume ASC NULLS FIRST)
               + 0.1 * percent_rank() OVER (ORDER BY Active_Share ASC NULLS FIRST)) AS Composite_Score
      FROM mt)"""

COMPOSITE = MT + _SCORES
# Series over all rows of the sliced tickers, then the dates.
MT_SLICED = MT.replace("FROM sm GROUP BY", f"FROM sm WHERE {SLICED} GROUP BY")

VOLKPI = f"""vk AS (SELECT Ticker, IndexName, CAST(sum({POS}) AS DOUBLE) / NULLIF(count({POS}), 0) AS Average_Volume,
        max({POS}) AS Highest_Volume, min({POS}) AS Lowest_Volume FROM bars GROUP BY Ticker, IndexName)"""


def _kpis(src: str) -> str:
    return f"""SELECT count(DISTINCT m.Country) AS Total_Countries, count(DISTINCT b.TradeDate) AS Trading_Days,
        max(b.ClosePrice) AS Highest_Index_Level, min(b.ClosePrice) AS Lowest_Index_Level,
        CAST(sum(b.ClosePrice) AS DOUBLE) / NULLIF(count(b.ClosePrice), 0) AS Average_Index_Level,
        CAST(sum(b.Volume) AS BIGINT) AS Total_Volume
        FROM {src} b LEFT JOIN dim_market m ON m.Ticker = b.Ticker"""


def measures_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    dm = (DIM_MARKET,)
    o["d01_kpis"] = sql(_kpis("bars"), extra=dm)
    o["d02_market_trend"] = sql(f"""SELECT Ticker, IndexName, {YEAR} AS Year, {MONTH} AS MonthNumber,
        CAST(sum(ClosePrice) AS DOUBLE) / NULLIF(count(ClosePrice), 0) AS Average_Close
        FROM bars GROUP BY Ticker, IndexName, year(TradeDate), month(TradeDate)""")
    best_worst = """SELECT 'Best' AS Category, Ticker, IndexName, YTD_Return FROM f WHERE b = 1
        UNION ALL SELECT 'Worst' AS Category, Ticker, IndexName, YTD_Return FROM f WHERE w = 1"""
    best_worst_f = """,
        f AS (SELECT *, rank() OVER (ORDER BY YTD_Return DESC) AS b, rank() OVER (ORDER BY YTD_Return ASC) AS w
              FROM mt WHERE YTD_Return IS NOT NULL)"""
    o["d03_best_worst"] = sql(best_worst, ctes=MT + best_worst_f)
    o["d03_best_worst_sliced"] = sql(best_worst, extra=dm, ctes=MT_SLICED + best_worst_f)
    o["d04_volume_trend"] = sql(f"""SELECT Ticker, IndexName, {YEAR} AS Year, {MONTH} AS MonthNumber,
        CAST(sum(Volume) AS BIGINT) AS Total_Volume
        FROM bars GROUP BY Ticker, IndexName, year(TradeDate), month(TradeDate)""")
    o["d05_regional"] = sql("""SELECT m.Country, count(*) AS Markets, avg(mt.YTD_Return) AS Average_YTD_Return,
        CAST(sum(mt.Total_Volume) AS BIGINT) AS Total_Volume
        FROM mt LEFT JOIN dim_market m ON m.Ticker = mt.Ticker GROUP BY m.Country""", extra=dm, ctes=MT)
    o["d06_ytd_return"] = sql("""SELECT TradeDate, Ticker, IndexName, ClosePrice,
        CAST(ClosePrice AS DOUBLE) / NULLIF(CAST(first_value(ClosePrice) OVER (PARTITION BY Ticker, year(TradeDate)
          ORDER BY TradeDate) AS DOUBLE), 0) - 1 AS YTD_Return FROM bars""")
    up, down = "CASE WHEN ClosePrice > prev THEN 1 ELSE 0 END", "CASE WHEN ClosePrice < prev THEN 1 ELSE 0 END"
    o["d07_breadth"] = sql(f"""SELECT TradeDate, CAST(sum({up}) AS BIGINT) AS Risers,
        CAST(sum({down}) AS BIGINT) AS Fallers,
        CAST(sum({up}) AS DOUBLE) / NULLIF(CAST(sum({up}) + sum({down}) AS DOUBLE), 0) AS Breadth_Ratio
        FROM r1 GROUP BY TradeDate""",
        ctes="r1 AS (SELECT *, lag(ClosePrice) OVER (PARTITION BY Ticker ORDER BY TradeDate) AS prev FROM bars)")
    o["d08_volume_kpis"] = sql("SELECT * FROM vk", ctes=VOLKPI)
    o["d09_volume_share"] = sql("""SELECT Ticker, IndexName, Total_Volume,
        CAST(Total_Volume AS DOUBLE) / NULLIF(CAST(sum(Total_Volume) OVER () AS DOUBLE), 0) AS Volume_Share FROM v""",
        ctes="v AS (SELECT Ticker, IndexName, CAST(sum(Volume) AS BIGINT) AS Total_Volume FROM bars "
             "GROUP BY Ticker, IndexName)")
    o["d10_liquidity"] = sql("""SELECT Ticker, IndexName, Average_Volume, Liquidity_Tier,
        CASE Liquidity_Tier WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS Liquidity_Rating
        FROM (SELECT *, CAST(ntile(3) OVER (ORDER BY Average_Volume DESC NULLS LAST, Ticker) AS INTEGER)
              AS Liquidity_Tier FROM vk) t""", ctes=VOLKPI)
    o["d11_rolling_vol20"] = sql("SELECT TradeDate, Ticker, IndexName, Daily_Return, Rolling_Volatility_20 FROM sm",
                                 ctes=SERIES)
    o["d11_rolling_vol20_range"] = sql("""SELECT TradeDate, Ticker, IndexName, Daily_Return, Rolling_Volatility_20
        FROM sm WHERE TradeDate BETWEEN DATE '1999-03-01' AND DATE '1999-03-31'""", ctes=SERIES)
    o["d12_volatility_by_country"] = sql("""SELECT m.Country, count(*) AS Markets,
        avg(mt.Volatility_20) AS Average_Volatility_20, max(mt.Volatility_20) AS Highest_Volatility_20
        FROM mt LEFT JOIN dim_market m ON m.Ticker = mt.Ticker GROUP BY m.Country""", extra=dm, ctes=MT)
    risk = """SELECT Ticker, IndexName, Average_Return, Return_StdDev, Min_Return, Max_Return, Volatility_20 FROM mt"""
    o["d13_risk_table"] = sql(risk, ctes=MT)
    o["d13_risk_table_sliced"] = sql(risk, extra=dm, ctes=MT_SLICED)
    o["d14_risk_score"] = sql("""SELECT Ticker, IndexName, Volatility_20,
        100.0 * percent_rank() OVER (ORDER BY Volatility_20 ASC NULLS FIRST) AS Risk_Score FROM mt""", ctes=MT)
    o["d15_volume_growth"] = sql("""SELECT Ticker, IndexName, Year, MonthNumber, Monthly_Volume, Previous_Volume,
        CAST(Monthly_Volume - Previous_Volume AS DOUBLE) / NULLIF(CAST(Previous_Volume AS DOUBLE), 0) * 100
          AS Volume_Growth_Pct
        FROM (SELECT *, lag(Monthly_Volume) OVER (PARTITION BY Ticker ORDER BY Year, MonthNumber) AS Previous_Volume
              FROM m) t""",
        ctes=f"""m AS (SELECT Ticker, IndexName, {YEAR} AS Year, {MONTH} AS MonthNumber,
          CAST(sum(Volume) AS BIGINT) AS Monthly_Volume FROM bars
          GROUP BY Ticker, IndexName, year(TradeDate), month(TradeDate))""")
    o["d16_composite"] = sql("SELECT * FROM comp", ctes=COMPOSITE)
    ranking = """SELECT Ticker, IndexName, Composite_Score,
        CAST(rank() OVER (ORDER BY Composite_Score DESC) AS INTEGER) AS Market_Rank FROM comp"""
    o["d17_ranking"] = sql(ranking, ctes=COMPOSITE)
    o["d17_ranking_sliced"] = sql(ranking, extra=dm, ctes=MT_SLICED + _SCORES)
    picks = [("Best performer", "YTD_Return", "DESC"), ("Worst performer", "YTD_Return", "ASC"),
             ("Highest risk", "Risk_Score", "DESC"), ("Lowest risk", "Risk_Score", "ASC"),
             ("Most liquid", "Average_Volume", "DESC"), ("Top ranked", "Composite_Score", "DESC")]
    union = "\n        UNION ALL ".join(
        f"(SELECT '{t}' AS Insight_Type, Ticker, IndexName, CAST({c} AS DOUBLE) AS Metric_Value FROM c "
        f"WHERE {c} IS NOT NULL ORDER BY {c} {d}, Ticker LIMIT 1)" for t, c, d in picks)
    o["d18_insights"] = sql("""SELECT Insight_Type, Ticker, IndexName, Metric_Value,
        printf('%s: %s (%s)', Insight_Type, Ticker, IndexName) AS Insight FROM picks""",
        ctes=COMPOSITE + """,
        c AS (SELECT *, 100.0 * percent_rank() OVER (ORDER BY Volatility_20 ASC NULLS FIRST) AS Risk_Score FROM comp),
        picks AS (""" + union + ")")
    o["d19_drilldown"] = sql("""SELECT Ticker, Year, Quarter, MonthNumber,
        CAST(GROUPING(Ticker, Year, Quarter, MonthNumber) AS INTEGER) AS Grouping_Level, count(*) AS Trading_Days,
        CAST(sum(ClosePrice) AS DOUBLE) / NULLIF(count(ClosePrice), 0) AS Average_Close,
        CAST(sum(Volume) AS BIGINT) AS Total_Volume
        FROM b GROUP BY ROLLUP (Ticker, Year, Quarter, MonthNumber)""",
        ctes=f"""b AS (SELECT Ticker, {YEAR} AS Year, CAST(quarter(TradeDate) AS INTEGER) AS Quarter,
          {MONTH} AS MonthNumber, ClosePrice, Volume FROM bars)""")
    o["d20_star"] = sql(f"""SELECT b.TradeDate, b.Ticker, b.IndexName, m.Country, {YEAR.replace('TradeDate', 'b.TradeDate')} AS Year,
        CAST(quarter(b.TradeDate) AS INTEGER) AS Quarter, {MONTH.replace('TradeDate', 'b.TradeDate')} AS MonthNumber,
        monthname(b.TradeDate) AS MonthName, b.ClosePrice, b.Volume
        FROM bars b LEFT JOIN dim_market m ON m.Ticker = b.Ticker""", extra=dm)
    o["d21_slicer"] = sql(_kpis("sb"), extra=dm, ctes="""sb AS (SELECT * FROM bars
          WHERE TradeDate >= DATE '1997-01-01' AND TradeDate <= DATE '1999-12-31'
            AND Ticker IN (SELECT Ticker FROM dim_market WHERE Country IN ('ASIA')))""")
    return o
