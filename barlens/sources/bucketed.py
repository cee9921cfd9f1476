"""Bars stored by series: bucketed by ticker, each bucket one sorted file a write.

Spark reads such a table as hash-partitioned by ticker, so series windows, the latest row of a
series, aggregates by ticker and the key check of an append take no Exchange of the
history: the shuffle is paid once, when rows are written. Files by year
(``sources.files``) prune dates instead; which layout fits depends on the reads.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.operators import ingest
from barlens.schema import BAR_COLUMNS, STORED_BARS
from barlens.sources.files import write_once

# A join on (TradeDate, Ticker) may use a table that is dealt by Ticker alone.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def write_bucketed(rows: DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "append") -> None:
    """Write stored-layout or plain bars as table ``table``: ``buckets`` files a write, sorted by (Ticker, TradeDate).

    A fixed number of buckets bounds a bucket's size by the number of tickers and the
    calendar; it is a property of the table and cannot change between writes.
    """
    for f in STORED_BARS.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = rows.select(*STORED_BARS.names).repartition(buckets, "Ticker").write.mode(mode).format("parquet") \
        .bucketBy(buckets, "Ticker").sortBy("Ticker", "TradeDate")
    (out if path is None else out.option("path", path)).saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str, extra: list[str] | None = None) -> DataFrame:
    return spark.table(table).select(*(list(extra or []) + BAR_COLUMNS))


@contextmanager
def dealt_as_stored(spark: SparkSession, buckets: int):
    """Plans made inside keep the table's side of a join on (TradeDate, Ticker) where it is and deal the other to its buckets."""
    parts = "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (CO_PARTITION, parts)}
    spark.conf.set(CO_PARTITION, "false")
    # The planner prefers a shuffle of both sides to fewer partitions than this.
    spark.conf.set(parts, str(min(int(before[parts]), buckets)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def append_bucketed(spark: SparkSession, rows: DataFrame, table: str, buckets: int, created_at=None) -> None:
    """Append the rows with unknown keys. The batch is dealt to the table's buckets; the table stays where it is."""
    with dealt_as_stored(spark, buckets):
        stored = read_bucketed(spark, table, extra=["PriceID", "CreatedAt"])
        # Written first: a table can't be appended to from a plan that reads it.
        fresh = write_once(ingest.e07_new_rows(stored, rows, created_at), "batch")
    write_bucketed(fresh, table, buckets)
