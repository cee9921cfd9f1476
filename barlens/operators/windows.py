"""Per-series window operators (lag, running, sliding, ranks, first/last).

Every series window is ``PARTITION BY <ticker or index> ORDER BY TradeDate``. A
series has one row a trading day once the load has enforced its unique
(TradeDate, Ticker) key, so the calendar bounds a ticker's partition and the
window as written is the plan: one Exchange on the series key.

* ``"plain"`` (default): that window.
* ``"blocked"``, only where the caller asks for it: for series that the calendar
  does not bound (many tickers under one index name, ticks). The series is cut
  into (series, year) blocks; what a block needs from earlier blocks is computed
  on small per-block tables and joined back: the carried running total/max/min,
  the count of earlier rows and dates for ranks, and for ROWS frames of n rows
  the last n-1 earlier rows as a margin. No block holds more than a year of one
  series plus the margin. It reads its input several times: pass a stored table.

Both give the same rows for any input, NULL keys included (block joins are
null-safe). Rows of one date are ordered by Ticker as well in lag, ROWS frames,
row numbers and first/last; RANGE frames and ranks go by the date alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_blk"
TIE_BREAK = "Ticker"


def _parts(part) -> list[str]:
    return [part] if isinstance(part, str) else list(part)


def _ordering(df: DataFrame, order: str, tie: bool) -> list[str]:
    return [order, TIE_BREAK] if tie and TIE_BREAK in df.columns and order != TIE_BREAK else [order]


def _w(df: DataFrame, part, order: str, desc: bool = False, tie: bool = True):
    cols = [F.col(c).desc() if desc else F.col(c).asc() for c in _ordering(df, order, tie)]
    return Window.partitionBy(*_parts(part)).orderBy(*cols)


def _is_blocked(strategy: str | None) -> bool:
    if strategy not in (None, "plain", "blocked"):
        raise ValueError(f"strategy must be 'plain' or 'blocked', not {strategy!r}")
    return strategy == "blocked"


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    same = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_right_{i}"))
        same = one if same is None else same & one
    out = left.join(renamed, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_right_{i}" for i in range(len(keys))])


# --------------------------------------------------------------------------- lag
def with_lag(df: DataFrame, part, order: str, value: str, out: str, strategy=None) -> DataFrame:
    """``LAG(value) OVER (PARTITION BY part ORDER BY order)``."""
    return with_sliding(df, part, order, {out: ("lag", value)}, strategy=strategy)


# ----------------------------------------------------------------------- running
_RUN_FN = {"sum": F.sum, "max": F.max, "min": F.min}


def with_running(df: DataFrame, part, order: str, specs: dict, frame: str = "rows",
                 strategy=None) -> DataFrame:
    """Running aggregates from the first row of the series to the current row.

    ``specs`` maps output name -> (fn, value) with fn in sum, max, min and value a
    column name or expression. ``frame="rows"``: ROWS UNBOUNDED PRECEDING..CURRENT
    ROW; ``"range"``: the SQL default frame, where rows with the same order value
    are added together.
    """
    ps = _parts(part)
    vals = {o: (F.col(v) if isinstance(v, str) else v) for o, (_, v) in specs.items()}

    def frame_of(w):
        return w.rowsBetween(Window.unboundedPreceding, 0) if frame == "rows" else w

    rows = frame == "rows"
    w = frame_of(_w(df, ps, order, tie=rows))
    if not _is_blocked(strategy):
        return df.select("*", *[_RUN_FN[fn](vals[o]).over(w).alias(o) for o, (fn, _) in specs.items()])
    types = df.select(*[_RUN_FN[fn](vals[o]).over(w).alias(o)
                        for o, (fn, _) in specs.items()]).schema
    blk = df.withColumn(BLOCK, F.year(order)).select("*", *[vals[o].alias(f"_v_{o}") for o in specs])
    per = blk.groupBy(*ps, BLOCK).agg(*[_RUN_FN[fn](f"_v_{o}").alias(f"_b_{o}")
                                        for o, (fn, _) in specs.items()])
    wb = Window.partitionBy(*ps).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*ps, BLOCK, *[_RUN_FN[fn](f"_b_{o}").over(wb).alias(f"_c_{o}")
                                     for o, (fn, _) in specs.items()])
    inner = frame_of(_w(df, ps + [BLOCK], order, tie=rows))
    j = join_null_safe(blk, carry, ps + [BLOCK])
    outs = []
    for o, (fn, _) in specs.items():
        c, i = F.col(f"_c_{o}"), _RUN_FN[fn](f"_v_{o}").over(inner)
        if fn == "sum":
            r = F.coalesce(c + i, i, c)
        elif fn == "max":
            r = F.greatest(c, i)
        else:
            r = F.least(c, i)
        outs.append(r.cast(types[o].dataType).alias(o))
    drop = [BLOCK] + [f"_v_{o}" for o in specs] + [f"_c_{o}" for o in specs]
    return j.select("*", *outs).drop(*drop)


# ----------------------------------------------------------------------- sliding
def with_slides(df: DataFrame, outs: dict, w) -> DataFrame:
    """The columns of ``with_sliding`` over a given window.

    Exact kinds (avg, int_avg) cost the same whatever the frame's length: the running sum and
    count of the series, less their values n rows back. Sums are decimals, so the difference
    is exact, and all frames over one column share its running columns. ``stddev`` adds
    up doubles, which no difference gives back exactly: its frame is the window's own.
    """
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    exact = sorted({spec[1] for spec in outs.values() if spec[0] in ("avg", "int_avg")})
    whole = {c for c in exact if not isinstance(df.schema[c].dataType, T.DecimalType)}
    runs = []
    for i, c in enumerate(exact):
        x = F.col(c).cast(T.DecimalType(38, 0)) if c in whole else F.col(c)
        runs += [F.coalesce(F.sum(x).over(run), F.lit(0)).alias(f"_sum_{i}"), F.count(c).over(run).alias(f"_count_{i}")]
    d = df.select("*", *runs)

    def within(name: str, n: int) -> Column:
        return F.col(name) - F.coalesce(F.lag(name, n).over(w), F.lit(0))

    cols = []
    for o, spec in outs.items():
        kind, col, n = spec[0], spec[1], spec[2] if len(spec) > 2 else None
        if kind in ("avg", "int_avg"):
            i = exact.index(col)
            total, count = within(f"_sum_{i}", n), F.nullif(within(f"_count_{i}", n), F.lit(0))
            cols.append((total.cast("double") / count if kind == "avg"
                         else F.call_function("div", total.cast("bigint"), count)).alias(o))
        elif kind == "stddev":
            cols.append(F.stddev_samp(col).over(w.rowsBetween(-(n - 1), 0)).alias(o))
        elif kind == "lag":
            cols.append(F.lag(col).over(w).alias(o))
        else:
            raise ValueError(kind)
    return d.select(*df.columns, *cols)


def with_block_stddev(df: DataFrame, part, order: str, col: str, n: int, out: str) -> DataFrame:
    """Adds ``out``: STDDEV_SAMP(col) over ROWS n-1 PRECEDING, at a cost that n does not change.

    For doubles and long frames. A series is cut into blocks of n rows; a frame is the end of
    one block and the start of the next, so it merges the moments (count, mean, squared deviations) of
    the block so far with those of the rows that the block before still has in the frame. No
    difference of large sums is taken, so no digits cancel.
    """
    ps = _parts(part)
    w = _w(df, ps, order)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_i") / n))

    def moments(direction) -> Column:
        over = Window.partitionBy(*ps, "_b").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        count = F.count(col).over(over)
        return F.struct(count.alias("n"), F.avg(col).over(over).alias("m"),
                        (F.var_pop(col).over(over) * count).alias("s"))

    d = d.withColumn("_tail", moments(F.col("_i").desc())).withColumn("_head", moments(F.col("_i").asc()))
    before = F.lag("_tail", n - 1).over(Window.partitionBy(*ps).orderBy("_i"))
    # The last row of a block has the whole frame in its block.
    d = d.withColumn("_tail", F.when(F.col("_i") % n != n - 1, before))
    zero = lambda part, field: F.coalesce(F.col(f"{part}.{field}"), F.lit(0))
    na, nb = zero("_tail", "n"), zero("_head", "n")
    apart = zero("_head", "m") - zero("_tail", "m")
    count = na + nb
    squares = zero("_tail", "s") + zero("_head", "s") + F.when((na > 0) & (nb > 0), apart * apart * na * nb / count).otherwise(0.0)
    return d.select(*df.columns, F.when(count > 1, F.sqrt(squares / F.greatest(count - 1, F.lit(1)))).alias(out))


def with_sliding(df: DataFrame, part, order: str, outs: dict, strategy=None) -> DataFrame:
    """Aggregates over ROWS BETWEEN n-1 PRECEDING AND CURRENT ROW.

    ``outs`` maps output name -> (kind, column, n), kind in avg, int_avg, stddev;
    or (``"lag"``, column) for the previous row.
    """
    ps = _parts(part)
    m = max((s[2] if len(s) > 2 else 2) for s in outs.values()) - 1
    return with_frames(df, ps, order, m, lambda d, w: with_slides(d, outs, w),
                       strategy=strategy)


def with_frames(df: DataFrame, part, order: str, margin: int, build, strategy=None) -> DataFrame:
    """Run ``build(frame_df, window)`` where every row can see its ``margin``
    preceding rows of the series.

    ``window`` is the per-series window (partition, order) to use in ``build``;
    ``frame_df`` may hold extra earlier rows which are removed afterwards, so
    ``build`` must only add columns. Plain: ``frame_df`` is ``df`` and the window is the series.
    Blocked: the window is (series, year) and each block gets the last
    ``margin`` rows before it, so ROWS frames up to ``margin`` PRECEDING (and
    chains of them, e.g. a lag feeding a rolling statistic, within ``margin``
    rows in total) are exact.
    """
    ps = _parts(part)
    if not _is_blocked(strategy):
        return build(df, _w(df, ps, order))
    m = margin
    blk = df.withColumn(BLOCK, F.year(order))
    # Last m rows of every block: a top-m per group, limited before its shuffle.
    tails = (blk.withColumn("_r", F.row_number().over(_w(df, ps + [BLOCK], order, desc=True)))
             .filter(F.col("_r") <= m))
    # Block table: rows up to the end of each block, and the next m blocks with
    # the number of rows before each of them.
    counts = blk.groupBy(*ps, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    wcum = Window.partitionBy(*ps).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_end", F.sum("_n").over(wcum))
    nxt = Window.partitionBy(*ps).orderBy(BLOCK).rowsBetween(1, m)
    counts = counts.withColumn(
        "_next", F.collect_list(F.struct(F.col(BLOCK).alias("b"),
                                         (F.col("_end") - F.col("_n")).alias("p"))).over(nxt))
    # A tail row r rows from the end of its block is needed by a later block whose
    # first row is at most m rows after it.
    margin_rows = (join_null_safe(tails, counts.select(*ps, BLOCK, "_end", "_next"), ps + [BLOCK], "inner")
                   .select("*", F.explode("_next").alias("_t"))
                   .filter((F.col("_r") - 1) + (F.col("_t.p") - F.col("_end")) <= m - 1)
                   .withColumn(BLOCK, F.col("_t.b"))
                   .drop("_r", "_end", "_next", "_t")
                   .withColumn("_margin", F.lit(True)))
    allrows = blk.withColumn("_margin", F.lit(False)).unionByName(margin_rows)
    res = build(allrows, _w(df, ps + [BLOCK], order))
    return res.filter(~F.col("_margin")).drop(BLOCK, "_margin")


# ------------------------------------------------------------------------- ranks
def with_ranks(df: DataFrame, part, order: str, row_number: str | None = None,
               rank: str | None = None, dense_rank: str | None = None, strategy=None) -> DataFrame:
    """ROW_NUMBER / RANK / DENSE_RANK over (PARTITION BY part ORDER BY order)."""
    ps = _parts(part)
    if not _is_blocked(strategy):
        by_row, by_date = _w(df, ps, order), _w(df, ps, order, tie=False)
        cols = [(row_number, F.row_number().over(by_row)), (rank, F.rank().over(by_date)),
                (dense_rank, F.dense_rank().over(by_date))]
        return df.select("*", *[e.alias(o) for o, e in cols if o])
    blk = df.withColumn(BLOCK, F.year(order))
    per = blk.groupBy(*ps, BLOCK).agg(F.count(F.lit(1)).alias("_n"),
                                      (F.countDistinct(order) + F.max(F.col(order).isNull().cast("int"))).alias("_d"))
    wb = Window.partitionBy(*ps).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*ps, BLOCK, F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_cn"),
                       F.coalesce(F.sum("_d").over(wb), F.lit(0)).alias("_cd"))
    by_row, by_date = _w(df, ps + [BLOCK], order), _w(df, ps + [BLOCK], order, tie=False)
    j = join_null_safe(blk, carry, ps + [BLOCK])
    cols = [(row_number, F.row_number().over(by_row) + F.col("_cn")),
            (rank, F.rank().over(by_date) + F.col("_cn")),
            (dense_rank, F.dense_rank().over(by_date) + F.col("_cd"))]
    return (j.select("*", *[e.cast("int").alias(o) for o, e in cols if o])
            .drop(BLOCK, "_cn", "_cd"))


# -------------------------------------------------------------------- first/last
def with_first_last(df: DataFrame, part, order: str, value: str,
                    first: str | None = None, last: str | None = None, strategy=None) -> DataFrame:
    """FIRST_VALUE (default frame) and LAST_VALUE (whole partition) of ``value``.

    Blocked form: both are per-series aggregates (``min_by``/``max_by``) joined
    back; the planner broadcasts the per-series table when it is small, else a
    shuffle join whose skewed partitions adaptive execution splits.
    """
    ps = _parts(part)
    if not _is_blocked(strategy):
        w = _w(df, ps, order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cols = [(first, F.first(value).over(w)), (last, F.last(value).over(whole))]
        return df.select("*", *[e.alias(o) for o, e in cols if o])
    key = F.struct(*_ordering(df, order, True))
    aggs = []
    if first:
        aggs.append(F.min_by(value, key).alias(first))
    if last:
        aggs.append(F.max_by(value, key).alias(last))
    return join_null_safe(df, df.groupBy(*ps).agg(*aggs), ps)


def with_frames_between(df: DataFrame, part, order: str, margin: int, build, start=None, end=None) -> DataFrame:
    """``with_frames`` for rows with start <= order <= end only.

    The rows of the range and each series' last ``margin`` rows before it go into
    the window; the margin is cut off afterwards. Finding it takes a top-``margin``
    per series, limited in each task before its shuffle, so the window and its
    shuffle hold the range and the margin, not the history.
    """
    ps = _parts(part)
    inside = F.lit(True) if start is None else F.col(order) >= F.lit(start)
    if end is not None:
        inside = inside & (F.col(order) <= F.lit(end))
    rows = df.filter(inside).withColumn("_margin", F.lit(False))
    if start is not None:
        last = F.row_number().over(_w(df, ps, order, desc=True))
        earlier = (df.filter(F.col(order) < F.lit(start)).withColumn("_r", last)
                   .filter(F.col("_r") <= margin).drop("_r"))
        rows = rows.unionByName(earlier.withColumn("_margin", F.lit(True)))
    return build(rows, _w(df, ps, order)).filter(~F.col("_margin")).drop("_margin")
