"""Bar tables derived from the driver's TPC-H-style tables (see FIXTURES.md).

* ``bars``: five tickers (order priorities) of daily bars from ``orders`` and the
  order volume from ``lineitem``.
* ``bars_wide``: one ticker per part from ``lineitem``; the scale table.
* ``bars_dirty``: ``bars`` with planted errors and repeated keys, for the checks.
* ``dim_market``, ``dim_date``, ``feed`` and ``history`` for ingest and measures.

Plan shape of ``bars`` at any size: lineitem is pre-aggregated per order key
(partial + final aggregate), joined to orders on the order key (sort-merge or,
when small enough at run time, broadcast), then aggregated per (date, ticker)
with a map-side partial aggregate, so a hot order key or a hot ticker collapses
before any shuffle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.schema import BAR_COLUMNS, FEED_RENAMES, PRICE
from barlens.sources.tables import read_table

# Fixed values of the fixture (FIXTURES.md): the cut-off of already-loaded rows,
# the ticker that has no high-water mark yet, and the default first load date.
HISTORY_BEFORE = _dt.date(2000, 1, 1)
HISTORY_MISSING_TICKER = "5-LOW"
DEFAULT_START = _dt.date(1995, 1, 1)


def _index_name(ticker_col) -> F.Column:
    return F.concat(F.lit("Index "), F.substring(ticker_col, 1, 1))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    qty = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"])
           .groupBy("l_orderkey").agg(F.sum("l_quantity").alias("_q")))
    joined = orders.join(qty, orders.o_orderkey == qty.l_orderkey, "left")
    agg = (joined.groupBy(F.col("o_orderdate").cast("date").alias("TradeDate"),
                          F.col("o_orderpriority").alias("Ticker"))
           .agg(F.min_by("o_totalprice", "o_orderkey").cast(PRICE).alias("OpenPrice"),
                F.max("o_totalprice").cast(PRICE).alias("HighPrice"),
                F.min("o_totalprice").cast(PRICE).alias("LowPrice"),
                F.max_by("o_totalprice", "o_orderkey").cast(PRICE).alias("ClosePrice"),
                F.coalesce(F.sum("_q"), F.lit(0.0)).cast("bigint").alias("Volume")))
    return agg.withColumn("IndexName", _index_name(F.col("Ticker"))).select(*BAR_COLUMNS)


def bars_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker per part key: 20,000 tickers at sf0.1.

    Open and close are the prices of the first and last line by (order key, line
    number, price), packed into one decimal(38,0): exact at any key size, and the
    aggregate stays a hash aggregate (a struct would make it sort).
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                     "l_extendedprice", "l_shipdate"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    line = (wide("l_orderkey") * 10 + wide("l_linenumber")).cast("decimal(24,0)")
    k = (line * F.lit(100_000_000).cast("decimal(10,0)")
         + F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")).cast("decimal(38,0)")
    agg = (li.groupBy(F.col("l_shipdate").cast("date").alias("TradeDate"), "l_partkey")
           .agg(F.min_by("l_extendedprice", k).cast(PRICE).alias("OpenPrice"),
                F.max("l_extendedprice").cast(PRICE).alias("HighPrice"),
                F.min("l_extendedprice").cast(PRICE).alias("LowPrice"),
                F.max_by("l_extendedprice", k).cast(PRICE).alias("ClosePrice"),
                F.sum("l_quantity").cast("bigint").alias("Volume")))
    pk = F.col("l_partkey").cast("string")
    return (agg.withColumn("Ticker", F.concat(F.lit("P"), pk))
            .withColumn("IndexName", F.concat(F.lit("Part "), pk))
            .select(*BAR_COLUMNS))


def bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bars`` with planted errors (keyed on the date digits) plus repeated rows."""
    b = bars(spark, sf_dir)
    dk = F.year("TradeDate") * 10000 + F.month("TradeDate") * 100 + F.dayofmonth("TradeDate")
    t = b.withColumn("_dk", dk)
    hit = lambda m: (F.col("_dk") % m) == 0
    planted = t.select(
        F.when(hit(67), F.add_months("TradeDate", 720)).otherwise(F.col("TradeDate")).alias("TradeDate"),
        "Ticker", "IndexName",
        F.when(hit(89), -F.col("OpenPrice")).otherwise(F.col("OpenPrice")).alias("OpenPrice"),
        F.when(hit(83), (F.col("LowPrice") - 1).cast(PRICE)).otherwise(F.col("HighPrice")).alias("HighPrice"),
        F.when(hit(79), (F.col("HighPrice") + 1).cast(PRICE)).otherwise(F.col("LowPrice")).alias("LowPrice"),
        F.when(hit(97), F.lit(None).cast(PRICE)).otherwise(F.col("ClosePrice")).alias("ClosePrice"),
        F.when(hit(73), F.lit(0).cast("bigint")).when(hit(71), F.lit(-5).cast("bigint"))
        .otherwise(F.col("Volume")).alias("Volume"))
    repeated = t.filter(hit(61)).select(*BAR_COLUMNS)
    return planted.unionByName(repeated)


def dim_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker -> IndexName, Country. Distinct tickers first (partial aggregate), then
    the five-row region table."""
    tickers = read_table(spark, sf_dir, "orders", ["o_orderpriority"]).distinct()
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    key = F.substring("o_orderpriority", 1, 1).cast("int") % 3
    return (tickers.join(region, key == region.r_regionkey)
            .select(F.col("o_orderpriority").alias("Ticker"),
                    _index_name(F.col("o_orderpriority")).alias("IndexName"),
                    F.col("r_name").alias("Country")))


def dim_market_from(spark: SparkSession, markets: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Market dimension from an in-code mapping {ticker: (index name, country)}."""
    from barlens.schema import DIM_MARKET
    return spark.createDataFrame([(t, n, c) for t, (n, c) in markets.items()], DIM_MARKET)


def date_columns() -> list[F.Column]:
    """The date dimension's columns, from TradeDate."""
    return [F.year("TradeDate").cast("int").alias("Year"), F.quarter("TradeDate").cast("int").alias("Quarter"),
            F.month("TradeDate").cast("int").alias("MonthNumber"), F.date_format("TradeDate", "MMMM").alias("MonthName")]


def dim_date(bars_df: DataFrame) -> DataFrame:
    """One row per trading date; its size is bounded by the calendar span."""
    return bars_df.select("TradeDate").distinct().select("TradeDate", *date_columns())


def feed_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_planted_faults(feed(spark, sf_dir))


def with_planted_faults(f: DataFrame) -> DataFrame:
    """A feed with planted NULL keys, NULL closes and unknown tickers (keyed on the date digits)."""
    dk = F.year("Date") * 10000 + F.month("Date") * 100 + F.dayofmonth("Date")
    hit = lambda m: (F.col("_dk") % m) == 0
    t = f.withColumn("_dk", dk)
    return t.select(F.when(~hit(61), F.col("Date")).alias("Date"),
                    F.when(hit(67), F.concat(F.lit("X-"), F.col("Ticker"))).when(~hit(71), F.col("Ticker")).alias("Ticker"),
                    "Open", "High", "Low", F.when(~hit(73), F.col("Close")).alias("Close"), "Volume")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``bars`` in the vendor's column names, without the index name."""
    back = {v: k for k, v in FEED_RENAMES.items()}
    b = bars(spark, sf_dir)
    return b.select(*[F.col(c).alias(back.get(c, c)) for c in BAR_COLUMNS if c != "IndexName"])


def as_vendor(rows: DataFrame, markets: DataFrame) -> DataFrame:
    """Feed rows as the vendor returns many tickers: a row a date, a struct a field with one member a ticker."""
    tickers = sorted(r[0] for r in markets.select("Ticker").collect())  # one column each
    fields = [c for c in rows.columns if c not in ("Date", "Ticker")]
    wide = rows.groupBy("Date").pivot("Ticker", tickers).agg(F.first(F.struct(*fields)))
    return wide.select("Date", *[F.struct(*[F.col(f"`{t}`").getField(c).alias(t) for t in tickers]).alias(c) for c in fields])


def feed_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_vendor(feed(spark, sf_dir), dim_market(spark, sf_dir))


def factors_of(rows: DataFrame) -> DataFrame:
    """Planted splits and dividends of bars (keyed on the date digits)."""
    dk = F.year("TradeDate") * 10000 + F.month("TradeDate") * 100 + F.dayofmonth("TradeDate")
    split, cash = (dk % 101) == 0, (dk % 37) == 0
    return rows.filter(split | cash).select(
        "Ticker", F.col("TradeDate").alias("ExDate"), F.when(split, F.lit(0.5)).alias("SplitFactor"),
        F.when(cash, F.lit(0.984375)).alias("DividendFactor"))


def price_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors_of(bars(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows already loaded before the incremental run; one ticker has none yet."""
    b = bars(spark, sf_dir)
    return b.filter((F.col("TradeDate") < F.lit(HISTORY_BEFORE))
                    & (F.col("Ticker") != F.lit(HISTORY_MISSING_TICKER)))
