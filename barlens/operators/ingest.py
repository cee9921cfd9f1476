"""Incremental load of daily bars (e01-e07).

The reference loops over tickers on the driver, asks the database for each
ticker's last date, downloads from the next day and appends. Here every step is
one DataFrame over all tickers:

e01 high-water mark per ticker (one grouped max), e02 next start date, e03
conform the feed (rename, label by the market dimension; rows that cannot be
loaded come out of ``e03_rejects`` with the reason; ``e03_flatten`` for the vendor's
two-level columns), e04 keep feed rows on or after each ticker's start, e05 stack them
under the loaded rows, e06 profile (rows, columns, types, NULLs, repeated rows by their
hashes), e07 append only unknown (TradeDate, Ticker) keys with a dense surrogate key
(``append.append_checked`` fails the whole batch instead). Running the load twice adds
nothing, so a retried or restarted job cannot double rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.operators.ranking import with_cumulative
from barlens.schema import BAR_COLUMNS, FEED_RENAMES
from barlens.sources.files import write_once

KEY = ["TradeDate", "Ticker"]


def e01_high_water_mark(loaded: DataFrame, markets: DataFrame) -> DataFrame:
    """Last loaded date of every configured ticker (NULL when it has none)."""
    marks = loaded.groupBy("Ticker").agg(F.max("TradeDate").alias("LastTradeDate"))
    return markets.select("Ticker").join(marks, "Ticker", "left")


def e02_start_date(marks: DataFrame, default_start: _dt.date) -> DataFrame:
    """The day after the mark, or ``default_start`` for a ticker never loaded."""
    return marks.select("Ticker", F.coalesce(F.date_add("LastTradeDate", 1), F.lit(default_start))
                        .alias("StartDate"))


REQUIRED = [c for c in BAR_COLUMNS if c != "IndexName"]


def _labelled(feed: DataFrame, markets: DataFrame) -> DataFrame:
    """The feed in table columns, with the index name (NULL for an unknown ticker) and ``Reason``:
    why a row cannot be loaded, NULL if it can. A ticker must have one index name."""
    rows = feed.withColumnsRenamed(FEED_RENAMES)
    names = markets.groupBy("Ticker").agg(F.min("IndexName").alias("IndexName"),
                                          F.max("IndexName").alias("_other"))
    out = rows.join(names, "Ticker", "left")
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in REQUIRED]
    reason = F.coalesce(*missing, F.when(F.col("IndexName").isNull(), F.lit("unknown ticker")),
                        F.when(F.col("IndexName") != F.col("_other"), F.lit("two index names")))
    return out.withColumn("Reason", reason).drop("_other")


def e03_conform(feed: DataFrame, markets: DataFrame) -> DataFrame:
    """Vendor columns -> table columns, with the index name from the market dimension.

    Every column of the table is NOT NULL: rows with a NULL, or of a ticker that the
    dimension does not have (or has under two names), are in ``e03_rejects`` instead."""
    return _labelled(feed, markets).filter(F.col("Reason").isNull()).select(*BAR_COLUMNS)


def e03_rejects(feed: DataFrame, markets: DataFrame) -> DataFrame:
    """The feed rows that ``e03_conform`` leaves out, in table columns, with the reason."""
    return _labelled(feed, markets).filter(F.col("Reason").isNotNull()).select(*BAR_COLUMNS, "Reason")


def e03_flatten(wide: DataFrame, date: str = "Date") -> DataFrame:
    """The vendor's two-level columns (field, then ticker) as feed rows.

    ``wide`` has the date and a struct column a field, with one member a ticker. Each row
    becomes one row a ticker in one pass, whatever the number of tickers; a ticker that has
    no value on a date has no row. A ticker that a field lacks has NULL there."""
    fields = [f for f in wide.schema.fields if isinstance(f.dataType, T.StructType)]
    members = {f.name: set(f.dataType.names) for f in fields}
    tickers = sorted(set().union(*members.values()))
    kinds = {f.name: f.dataType.fields[0].dataType for f in fields}
    if not tickers:
        raise ValueError("no two-level column")

    def value(field: str, ticker: str):
        if ticker not in members[field]:
            return F.lit(None).cast(kinds[field])
        return F.col(f"`{field}`").getField(ticker)

    rows = F.array(*[F.struct(F.lit(t).alias("Ticker"), *[value(f, t).alias(f) for f in members]) for t in tickers])
    out = wide.select(F.col(f"`{date}`").alias(date), F.inline(rows))
    return out.filter(F.coalesce(*[F.col(f"`{f}`").cast("string") for f in members]).isNotNull())


def e04_incremental_rows(feed: DataFrame, loaded: DataFrame, markets: DataFrame,
                         default_start: _dt.date, marks: DataFrame | None = None) -> DataFrame:
    """Conformed feed rows on or after each ticker's start date.

    ``marks`` (Ticker, LastTradeDate), when kept by the loader, replaces the scan
    of ``loaded`` for the high-water marks."""
    if marks is None:
        marks = e01_high_water_mark(loaded, markets)
    else:
        marks = markets.select("Ticker").join(marks, "Ticker", "left")
    starts = e02_start_date(marks, default_start)
    rows = e03_conform(feed, markets)
    return (rows.join(starts, "Ticker").filter(F.col("TradeDate") >= F.col("StartDate"))
            .select(*BAR_COLUMNS))


def e05_union(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name (an empty frame adds nothing)."""
    out = frames[0].select(*BAR_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*BAR_COLUMNS))
    return out


SQL_TYPES = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


def e06_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, the type of each column, NULLs per column and repeated full rows (all but the first).

    Repeated rows are looked for by a hash of the whole row: only the hashes (8 bytes a row) are
    shuffled, those met twice are written, and the rows that have one of them are grouped by all
    columns, which makes the count exact. Where few rows repeat, the hashes' table is small
    enough for the planner to broadcast, and no other row leaves its task.
    """
    cols = df.columns
    mark = F.xxhash64(*cols)
    hashes = df.select(mark.alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_c"))
    met = write_once(hashes.filter(F.col("_c") > 1).select("_hash"), "repeated")
    again = df.withColumn("_hash", mark).join(met, "_hash", "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    repeated = F.coalesce(again.agg(F.sum(F.col("_c") - 1)).scalar(), F.lit(0))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(F.count(F.lit(1)).alias("Total_Rows"),
                    *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])
    return counts.select("Total_Rows", F.lit(len(cols)).alias("Total_Columns"),
                         *[F.lit(SQL_TYPES.get(k, k.upper())).alias(f"type_{c}") for c, k in kinds.items()],
                         *[f"null_{c}" for c in cols], repeated.alias("Duplicated_Rows"))


def with_price_id(df: DataFrame, start: int = 0) -> DataFrame:
    """Dense surrogate key 1..n (plus ``start``) in (Ticker, TradeDate) order.

    Rows are counted per (Ticker, year) block; the rows in earlier blocks, summed
    over value ranges (``ranking``), give each block's offset; the key is the offset
    plus the row number inside the block. No global sort, no window over more than
    a year of one ticker, and rows with a NULL key are numbered too (first).
    """
    block = F.struct("Ticker", F.year("TradeDate").alias("y"))
    rows = df.withColumn("_block", block)
    blocks = write_once(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")), "blocks")
    offsets = with_cumulative(blocks, "_block", "_n", "_off")[0].select("_block", "_off")
    inner = Window.partitionBy("_block").orderBy("TradeDate")
    return (rows.join(offsets, "_block")
            .withColumn("PriceID", (F.lit(start) + F.col("_off") + F.row_number().over(inner)).cast("bigint"))
            .drop("_block", "_off"))


def stored(df: DataFrame, created_at: _dt.datetime | None = None, start: int = 0) -> DataFrame:
    """Rows in the stored layout: PriceID, the bar columns, CreatedAt."""
    # Parsed from text straight into timestamp_ntz: no session time zone applies.
    stamp = (F.to_timestamp_ntz(F.lit(created_at.strftime("%Y-%m-%d %H:%M:%S")))
             if created_at is not None else F.lit(None).cast("timestamp_ntz"))
    return with_price_id(df, start).select("PriceID", *BAR_COLUMNS, stamp.alias("CreatedAt"))


def new_keys(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows whose (TradeDate, Ticker) is not in ``table``, one row per key: of rows
    that share a key, the one with the least column values (in table order).

    The table is large and the batch small, so the table is semi-joined against
    the batch keys first: the planner broadcasts the batch side when its size
    check allows (else a shuffle join), and the table is streamed, never
    shuffled. The anti-join then runs between two batch-sized sides.
    """
    rest = [c for c in BAR_COLUMNS if c not in KEY]
    rows = rows.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("_row")).select(*KEY, "_row.*")
    known = table.select(*KEY).join(rows.select(*KEY), KEY, "left_semi")
    return rows.join(known, KEY, "left_anti")


def e07_new_rows(table: DataFrame, rows: DataFrame, created_at: _dt.datetime | None = None,
                 last_id: int | None = None) -> DataFrame:
    """Stored-layout rows for the keys not yet in ``table``.

    New keys continue after ``last_id``, or after the table's largest PriceID
    (read with one small aggregate, like the reference's high-water query);
    ``created_at`` stamps the batch (default: now, UTC)."""
    fresh = new_keys(rows, table)
    top = last_id if last_id is not None else (table.agg(F.max("PriceID")).first()[0] or 0)
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    stamp = created_at if created_at is not None else now
    return stored(fresh, stamp, start=top)


def e07_append(table: DataFrame, rows: DataFrame, created_at: _dt.datetime | None = None) -> DataFrame:
    """The table after appending the rows with unknown keys."""
    return table.select("PriceID", *BAR_COLUMNS, "CreatedAt").unionByName(
        e07_new_rows(table, rows, created_at))
