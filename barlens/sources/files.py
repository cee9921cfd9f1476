"""Files at rest: landed feed files (one directory per ticker) and the bar table.

The bar table is parquet partitioned by year, so a year filter prunes whole
directories; the feed is partitioned by ticker, as the vendor lands one ticker at
a time. Both are read with a fixed schema, never inferred.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.operators.procedures import between_dates
from barlens.schema import BAR_COLUMNS, FEED, FEED_COLUMNS, STORED_BARS
from barlens.session import ensure_checkpoint_dir


# Tasks that write one year of bars, and at most as many files; tickers are dealt to them by hash.
YEAR_BUCKETS = 4


def write_feed_files(feed_df: DataFrame, root: str, mode: str = "append") -> None:
    """One folder a ticker, as the vendor lands them, and one file in each."""
    feed_df.select(*FEED_COLUMNS).repartition("Ticker").write.mode(mode).partitionBy("Ticker").parquet(root)


def read_feed_files(spark: SparkSession, root: str, start=None, end=None,
                    tickers: list[str] | None = None) -> DataFrame:
    """All landed tickers in one read (the per-ticker loop becomes a file listing).

    ``start`` (inclusive) and ``end`` (exclusive, as the vendor's end date) bound
    the dates; ``tickers`` prunes ticker folders. Both reach the scan."""
    df = spark.read.schema(FEED).option("basePath", root).parquet(root)
    if tickers:
        df = df.filter(F.col("Ticker").isin(list(tickers)))
    if start is not None:
        df = df.filter(F.col("Date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("Date") < F.lit(end))
    return df.select(*FEED_COLUMNS)


def by_year(bars_df: DataFrame, buckets: int = YEAR_BUCKETS) -> DataFrame:
    """Rows with Year, dealt by (year, ticker bucket) and sorted: at most ``buckets`` files a
    year, however many tasks made the rows, and row groups clustered by ticker, so a ticker
    filter skips most of each file."""
    rows = bars_df.withColumn("Year", F.year("TradeDate"))
    return rows.repartition("Year", F.pmod(F.hash("Ticker"), F.lit(buckets))) \
        .sortWithinPartitions("Year", "Ticker", "TradeDate")


def write_bars(bars_df: DataFrame, path: str, mode: str = "append", buckets: int = YEAR_BUCKETS) -> None:
    """Write bars partitioned by year."""
    by_year(bars_df, buckets).write.mode(mode).partitionBy("Year").parquet(path)


# The stored layout: key, bar columns, load stamp, and the year partition folder.
STORED_FILE_SCHEMA = T.StructType(STORED_BARS.fields + [T.StructField("Year", T.IntegerType(), True)])


def read_bars(spark: SparkSession, path: str, extra: list[str] | None = None, start=None, end=None) -> DataFrame:
    """The stored bar table with its fixed schema (no footer reads to infer one).
    Tables written without PriceID/CreatedAt read those as NULL; only the bar
    columns (and ``extra``) are selected. ``start``/``end`` (inclusive) bound the dates
    and prune year folders; with ``extra=["Year"]`` the date operators do the same later."""
    df = spark.read.schema(STORED_FILE_SCHEMA).parquet(path)
    return between_dates(df, start, end).select(*(list(extra or []) + BAR_COLUMNS))


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: what reads it several times
    computes it once, and a lost executor costs no more than a reread. The files go when the
    driver's JVM ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
