"""Incremental load as a Structured Streaming query.

The reference's load is a notebook run: per ticker, read the last loaded date,
download from the next day, append. Here the vendor lands feed files (one
directory per ticker) and a streaming query picks up every new file exactly once
(file source + checkpoint). Each micro-batch is loaded by ``load_batch``:

1. conform the batch (rename, label by the market dimension); rows that cannot be
   loaded are appended to ``_rejects`` with the reason,
2. drop keys already in the table (left anti-join on TradeDate, Ticker; only the
   year folders that the batch touches are read),
3. append with a dense PriceID and the batch stamp, partitioned by year.

Step 2 makes a batch idempotent: if an executor or the driver dies and the batch
is replayed, rows that were already committed are not appended again. A late file
(dates before a ticker's high-water mark) loads like any other: marks are kept for
readers and never reject a key that the table does not have. How files are split
into batches does not change which rows load.

The checkpoint lives in the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.operators import ingest
from barlens.schema import BAR_COLUMNS, FEED, STORED_BARS
from barlens.session import ensure_checkpoint_dir
from barlens.sources.bars import DEFAULT_START
from barlens.sources.files import by_year
from barlens.sources.footers import last_price_id


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if nothing is there; any other error is raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not any(_is_data(f) for f in fs.listStatus(where)):
        return None
    return spark.read.parquet(path)


def _is_data(status) -> bool:
    return not status.getPath().getName().startswith(("_", "."))


def load_batch(batch: DataFrame, table_path: str, markets: DataFrame,
               default_start: _dt.date = DEFAULT_START, created_at: _dt.datetime | None = None) -> int:
    """Append the new rows of one feed batch to the stored table; returns rows appended.

    Side tables live inside the table folder (Spark's reader skips folders starting
    with ``_``): ``_marks`` (last loaded date per ticker), ``_keys`` (last PriceID
    issued) and ``_rejects``. With them a batch never scans the whole table: the key
    check reads only the year partitions the batch touches. Order of writes: keys,
    rows, marks. A crash after the keys leaves a gap in PriceID (as an identity
    column does); a crash after the rows is repaired on replay, because the key check
    finds the rows already there and the marks are brought up to date again.
    """
    spark = batch.sparkSession
    table = _read(spark, table_path)
    is_new = table is None
    if is_new:
        table = spark.createDataFrame([], STORED_BARS).withColumn("Year", F.year("TradeDate"))
    keys = _read(spark, f"{table_path}/_keys")
    # Without the side table the greatest key is read from the files' footers.
    last_id = (keys.first()[0] if keys is not None else 0 if is_new else last_price_id(spark, table_path)) or 0

    rejects = ingest.e03_rejects(batch, markets)
    rows = ingest.e03_conform(batch, markets).filter(F.col("TradeDate") >= F.lit(default_start))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # The batch's years: at most one per calendar year of the batch.
        years = [r[0] for r in rows.select(F.year("TradeDate")).distinct().collect()]
        existing = table.filter(F.col("Year").isin(years)).select("PriceID", *BAR_COLUMNS, "CreatedAt")
        new = ingest.e07_new_rows(existing, rows, created_at, last_id=last_id).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = new.count()
            if n:
                spark.createDataFrame([(last_id + n,)], "LastPriceID long") \
                    .write.mode("overwrite").parquet(f"{table_path}/_keys")
                by_year(new).write.mode("append").partitionBy("Year").parquet(table_path)
            _update_marks(rows, table_path)
            if not rejects.isEmpty():
                rejects.write.mode("append").parquet(f"{table_path}/_rejects")
            return n
        finally:
            new.unpersist()
    finally:
        rows.unpersist()


def _update_marks(rows: DataFrame, table_path: str) -> None:
    """Last loaded date per ticker, the batch's rows (all in the table by now) included."""
    spark = rows.sparkSession
    marks = _read(spark, f"{table_path}/_marks")
    if marks is None:  # first run on an existing table: one scan builds the marks
        stored = _read(spark, table_path)
        marks = (stored if stored is not None else rows).groupBy("Ticker") \
            .agg(F.max("TradeDate").alias("LastTradeDate"))
    fresh = rows.groupBy("Ticker").agg(F.max("TradeDate").alias("LastTradeDate"))
    updated = marks.unionByName(fresh).groupBy("Ticker").agg(F.max("LastTradeDate").alias("LastTradeDate"))
    # Marks are one row per ticker; written to a new folder, then swapped in.
    tmp = f"{table_path}/_marks_next"
    updated.write.mode("overwrite").parquet(tmp)
    spark.read.parquet(tmp).write.mode("overwrite").parquet(f"{table_path}/_marks")


def start_feed_load(spark: SparkSession, landing: str, table_path: str, markets: DataFrame,
                    name: str = "feed-load", default_start: _dt.date = DEFAULT_START,
                    available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the streaming load of ``landing`` (``Ticker=.../*.parquet``) into ``table_path``.

    ``available_now=True`` processes what has landed and stops (a scheduled
    incremental run); otherwise it keeps running. Returns the StreamingQuery.
    """
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    reader = spark.readStream.schema(FEED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(landing)

    def _each(batch: DataFrame, epoch_id: int) -> None:
        load_batch(batch, table_path, markets, default_start)

    w = stream.writeStream.foreachBatch(_each).option("checkpointLocation", ckpt).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
