"""The append that a broken constraint fails as a whole.

The table's NOT NULL columns and its unique (TradeDate, Ticker) are checked by expressions of the
plan that writes the batch: a NULL, a key that the batch has twice or a key that the table has
already raises an error that names it, in the task that meets it. The batch is written aside first, so nothing
of a bad batch reaches the table. ``ingest.e07_append`` and the streaming load skip known keys instead.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barlens.operators import ingest
from barlens.schema import BAR_COLUMNS, STORED_BARS
from barlens.sources.files import write_bars, write_once
from barlens.sources.footers import last_price_id


def _raise_if(bad: Column, message: Column, column: str, kind) -> Column:
    return F.when(bad, F.raise_error(message).cast(kind)).otherwise(F.col(column)).alias(column)


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("NULL"))


def checked_rows(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` unchanged, or an error when they are computed.

    Only columns that cannot hold the error's cause are grouped by: a key of many rows costs one counted row."""
    key = F.concat(F.lit("(TradeDate, Ticker) = ("), _shown("TradeDate"), F.lit(", "), _shown("Ticker"), F.lit(")"))
    kinds = {f.name: f.dataType for f in STORED_BARS.fields}
    whole = rows.select(*[_raise_if(F.col(c).isNull(), F.concat(F.lit(f"NULL in column {c}, "), key), c, kinds[c]) for c in BAR_COLUMNS])
    rest = [c for c in BAR_COLUMNS if c not in ingest.KEY]
    once = whole.groupBy(*ingest.KEY).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    # The table is streamed past the batch's keys, as in the skipping load.
    known = table.select(*ingest.KEY).join(once.select(*ingest.KEY), ingest.KEY, "left_semi").withColumn("_known", F.lit(True))
    found = once.join(known, ingest.KEY, "left").select(*ingest.KEY, "_row.*", "_n", "_known")
    twice, again = F.col("_n") > 1, F.col("_known").isNotNull()
    message = F.concat(F.when(again, F.lit("key exists already, ")).otherwise(F.lit("key twice in the batch, ")), key)
    return found.withColumn("TradeDate", _raise_if(twice | again, message, "TradeDate", kinds["TradeDate"])).select(*BAR_COLUMNS)


def append_checked(table: DataFrame, rows: DataFrame, path: str, created_at: _dt.datetime | None = None) -> dict:
    """Append ``rows`` to the bars at ``path``, of which ``table`` are the stored rows; all of them or none.

    Returns what was loaded (rows, first and last date, tickers' volume), observed while the batch is written."""
    seen = Observation("append")
    batch = checked_rows(rows, table).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min("TradeDate").alias("first"), F.max("TradeDate").alias("last"),
        F.sum("Volume").alias("volume"))
    batch = write_once(batch, "batch")
    top = last_price_id(batch.sparkSession, path)
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    write_bars(ingest.stored(batch, created_at or now, start=top), path)
    return seen.get
