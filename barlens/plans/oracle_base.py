"""DuckDB SQL for the derived tables (FIXTURES.md), used as CTEs by every oracle.

Each oracle is ``WITH <base tables> <query>`` over the driver's registered views,
so it needs nothing but the raw tables.
"""

BARS = """bars AS (
  SELECT cast(o_orderdate AS date) AS TradeDate, o_orderpriority AS Ticker,
         concat('Index ', substr(o_orderpriority,1,1)) AS IndexName,
         cast(min_by(o_totalprice,o_orderkey) AS decimal(18,4)) AS OpenPrice,
         cast(max(o_totalprice) AS decimal(18,4)) AS HighPrice,
         cast(min(o_totalprice) AS decimal(18,4)) AS LowPrice,
         cast(max_by(o_totalprice,o_orderkey) AS decimal(18,4)) AS ClosePrice,
         cast(coalesce(sum(q),0) AS bigint) AS Volume
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l
    ON l_orderkey = o_orderkey
  GROUP BY cast(o_orderdate AS date), o_orderpriority, concat('Index ', substr(o_orderpriority,1,1))
)"""

BARS_WIDE = """bars AS (
  SELECT cast(l_shipdate AS date) AS TradeDate, concat('P', cast(l_partkey AS varchar(20))) AS Ticker,
         concat('Part ', cast(l_partkey AS varchar(20))) AS IndexName,
         cast(min_by(l_extendedprice, K) AS decimal(18,4)) AS OpenPrice,
         cast(max(l_extendedprice) AS decimal(18,4)) AS HighPrice,
         cast(min(l_extendedprice) AS decimal(18,4)) AS LowPrice,
         cast(max_by(l_extendedprice, K) AS decimal(18,4)) AS ClosePrice,
         cast(sum(l_quantity) AS bigint) AS Volume
  FROM (SELECT *, (l_orderkey*10 + l_linenumber)*100000000
                  + cast(round(l_extendedprice*100) AS bigint) AS K FROM lineitem) li
  GROUP BY cast(l_shipdate AS date), l_partkey
)"""

BARS_DIRTY = BARS.replace("bars AS (", "clean_bars AS (", 1) + """,
bars AS (
  SELECT CASE WHEN dk % 67 = 0 THEN cast(TradeDate + interval 60 year AS date) ELSE TradeDate END AS TradeDate,
         Ticker, IndexName,
         CASE WHEN dk % 89 = 0 THEN -OpenPrice ELSE OpenPrice END AS OpenPrice,
         CASE WHEN dk % 83 = 0 THEN cast(LowPrice - 1 AS decimal(18,4)) ELSE HighPrice END AS HighPrice,
         CASE WHEN dk % 79 = 0 THEN cast(HighPrice + 1 AS decimal(18,4)) ELSE LowPrice END AS LowPrice,
         CASE WHEN dk % 97 = 0 THEN NULL ELSE ClosePrice END AS ClosePrice,
         CASE WHEN dk % 73 = 0 THEN 0 WHEN dk % 71 = 0 THEN -5 ELSE Volume END AS Volume
  FROM (SELECT *, year(TradeDate)*10000 + month(TradeDate)*100 + day(TradeDate) AS dk FROM clean_bars) t
  UNION ALL
  SELECT * FROM clean_bars WHERE (year(TradeDate)*10000 + month(TradeDate)*100 + day(TradeDate)) % 61 = 0
)"""

DIM_MARKET = """dim_market AS (
  SELECT DISTINCT o_orderpriority AS Ticker, concat('Index ', substr(o_orderpriority,1,1)) AS IndexName,
         r_name AS Country
  FROM orders JOIN region ON r_regionkey = cast(substr(o_orderpriority,1,1) AS int) % 3
)"""

FEED = """feed AS (
  SELECT TradeDate AS "Date", Ticker, OpenPrice AS "Open", HighPrice AS High, LowPrice AS Low,
         ClosePrice AS "Close", Volume FROM bars
)"""

FEED_DIRTY = FEED + """,
feed_dirty AS (
  SELECT CASE WHEN dk % 61 <> 0 THEN "Date" END AS TradeDate,
         CASE WHEN dk % 67 = 0 THEN 'X-' || Ticker WHEN dk % 71 <> 0 THEN Ticker END AS Ticker,
         "Open" AS OpenPrice, High AS HighPrice, Low AS LowPrice,
         CASE WHEN dk % 73 <> 0 THEN "Close" END AS ClosePrice, Volume
  FROM (SELECT *, year("Date")*10000 + month("Date")*100 + day("Date") AS dk FROM feed) f
), labelled AS (
  SELECT TradeDate, Ticker, IndexName, OpenPrice, HighPrice, LowPrice, ClosePrice, Volume,
         CASE WHEN TradeDate IS NULL THEN 'TradeDate is null' WHEN Ticker IS NULL THEN 'Ticker is null'
              WHEN ClosePrice IS NULL THEN 'ClosePrice is null' WHEN IndexName IS NULL THEN 'unknown ticker'
         END AS Reason
  FROM feed_dirty LEFT JOIN (SELECT Ticker, IndexName FROM dim_market) USING (Ticker)
)"""

HISTORY = """history AS (
  SELECT * FROM bars WHERE TradeDate < DATE '2000-01-01' AND Ticker <> '5-LOW'
)"""

BASES = {"bars": BARS, "wide": BARS_WIDE, "dirty": BARS_DIRTY}


def sql(body: str, base: str = "bars", extra: tuple[str, ...] = (), ctes: str = "") -> str:
    """``WITH <base>[, extra...][, ctes] <body>``."""
    parts = [BASES[base], *extra]
    if ctes:
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
