"""Stored forms of the bars and what they save: prefix frames, buckets, month states, footers, checked appends."""

import datetime as dt
import os
import random
import re
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.operators import adjust, append, calendar, ingest, measures, month_state, procedures, returns, rolling, windows
from barlens.schema import BAR_COLUMNS
from barlens.sources import (bars, bars_wide, bucketed, dim_market, feed, feed_wide, footers, read_bars, write_bars, write_once)
from tests.conftest import SF001
from tests.helpers import assert_df_equal

BAR = "TradeDate date, Ticker string, IndexName string, OpenPrice decimal(18,4), HighPrice decimal(18,4), " \
      "LowPrice decimal(18,4), ClosePrice decimal(18,4), Volume bigint"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def odd_series(spark):
    """Series with NULLs in values, dates and tickers, and dates that repeat."""
    rnd = random.Random(8)
    rows = []
    for t in ["A", "B", None]:
        for i in range(60):
            close = None if rnd.random() < 0.2 else rnd.randint(1, 10**9) / 10**4
            rows.append((None if rnd.random() < 0.05 else day(i if rnd.random() < 0.9 else i // 2), t, "I", None, None, None,
                         None if close is None else __import__("decimal").Decimal(str(round(close, 4))),
                         rnd.choice([None, 0, 5, 2**40])))
    return spark.createDataFrame(rows, BAR).dropDuplicates(["TradeDate", "Ticker"]).cache()


# ----------------------------------------------------------------- sliding frames
@pytest.mark.parametrize("n", [1, 7, 30, 250])
def test_prefix_frames_equal_sliding_frames(odd_series, n):
    w = Window.partitionBy("Ticker").orderBy("TradeDate", "Ticker")
    frame = w.rowsBetween(-(n - 1), 0)
    got = windows.with_sliding(odd_series, "Ticker", "TradeDate", {"a": ("avg", "ClosePrice", n), "v": ("int_avg", "Volume", n)})
    want = odd_series.select(
        "*", (F.sum("ClosePrice").over(frame).cast("double") / F.nullif(F.count("ClosePrice").over(frame), F.lit(0))).alias("a"),
        F.call_function("div", F.sum("Volume").over(frame), F.nullif(F.count("Volume").over(frame), F.lit(0))).alias("v"))
    assert_df_equal(got, want)


@pytest.mark.parametrize("n", [1, 2, 7, 20, 100])
def test_block_stddev_equals_sliding_frame(odd_series, n):
    d = odd_series.withColumn("x", F.col("ClosePrice").cast("double") / 1000)
    w = Window.partitionBy("Ticker").orderBy("TradeDate", "Ticker")
    got = windows.with_block_stddev(d, "Ticker", "TradeDate", "x", n, "s").select("Ticker", "TradeDate", "s")
    want = d.select("Ticker", "TradeDate", F.stddev_samp("x").over(w.rowsBetween(-(n - 1), 0)).alias("s"))
    key = lambda r: (str(r[0]), str(r[1]))
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) == odd_series.count()
    for x, y in zip(a, b):
        assert (x["s"] is None) == (y["s"] is None), (x, y)
        assert x["s"] is None or x["s"] == pytest.approx(y["s"], rel=1e-9, abs=1e-9)


def test_block_stddev_of_equal_values_is_zero(spark):
    """No digits cancel: a flat series far from zero after a wild start."""
    rows = [(day(i), "A", 1e9 * (i % 2) if i < 50 else 12345.678) for i in range(200)]
    d = spark.createDataFrame(rows, "TradeDate date, Ticker string, x double")
    out = windows.with_block_stddev(d, "Ticker", "TradeDate", "x", 20, "s").where("TradeDate >= '2020-05-01'")
    assert out.agg(F.max("s")).first()[0] < 1e-9


def test_long_volatility(spark):
    b = bars(spark, SF001)
    got = measures.rolling_volatility(b, 20).withColumnRenamed("Rolling_Volatility", "Rolling_Volatility_20")
    both = got.alias("a").join(measures.d11_rolling_vol20(b).alias("b"), ["TradeDate", "Ticker"])
    off = F.abs(F.col("a.Rolling_Volatility_20") - F.col("b.Rolling_Volatility_20"))
    assert both.count() == b.count() and both.agg(F.max(off)).first()[0] < 1e-9


# -------------------------------------------------------------------- bucketed table
@pytest.fixture
def table(spark, scratch):
    name = f"bars_{uuid.uuid4().hex}"
    rows = ingest.stored(write_once(bars_wide(spark, SF001), "wide"))
    bucketed.write_bucketed(rows, name, 4, path=os.path.join(scratch, name))
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_series_windows_take_no_exchange_on_buckets(spark, table):
    b = bucketed.read_bucketed(spark, table)
    for fn in (returns.v1_daily_performance, rolling.v2_moving_averages, rolling.v3_running_metrics, procedures.p3_latest_snapshot):
        assert "Exchange" not in executed(fn(b)).replace("rangepartitioning", ""), fn.__name__
    assert_df_equal(rolling.v2_moving_averages(b), rolling.v2_moving_averages(bars_wide(spark, SF001)))


def above(plan, marker):
    """The plan's nodes on the way from the scan that holds `marker` up to the root."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if marker in x)
    depth, out = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for x in reversed(lines[:at]):
        d = len(x) - len(x.lstrip(" :+-*(0123456789)"))
        if d < depth:
            depth = d
            out.append(x)
    return out


def test_key_check_takes_no_exchange_of_the_history(spark, table):
    batch = bars_wide(spark, SF001).where("Volume % 3 = 0").unionByName(
        bars_wide(spark, SF001).limit(5).withColumn("TradeDate", F.date_add("TradeDate", 20000)))
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    try:
        spark.conf.set(broadcast, "-1")
        batch = write_once(batch, "batch")
        with bucketed.dealt_as_stored(spark, 4):
            fresh = ingest.new_keys(batch, bucketed.read_bucketed(spark, table))
            way = above(executed(fresh), f"{table}")
        semi = next(i for i, x in enumerate(way) if "LeftSemi" in x)
        assert not any("Exchange" in x for x in way[:semi])
        assert fresh.count() == 5
    finally:
        spark.conf.set(broadcast, before)


def test_append_to_buckets(spark, table):
    old = spark.table(table).count()
    new = bars_wide(spark, SF001).limit(7).withColumn("TradeDate", F.date_add("TradeDate", 20000))
    batch = write_once(new.unionByName(bars_wide(spark, SF001).limit(9)), "batch")
    for _ in range(2):
        bucketed.append_bucketed(spark, batch, table, 4, created_at=dt.datetime(2026, 1, 1))
    out = spark.table(table)
    assert out.count() == old + 7 and out.agg(F.count_distinct("PriceID")).first()[0] == old + 7
    assert "Exchange" not in executed(rolling.v3_running_metrics(bucketed.read_bucketed(spark, table)))


# ------------------------------------------------------------------------ month state
def rollups(state, rows):
    return [(month_state.v4_monthly_performance(state), calendar.v4_monthly_performance(rows)),
            (month_state.v5_yearly_performance(state), calendar.v5_yearly_performance(rows)),
            (month_state.q27_monthly(state), calendar.q27_monthly(rows)), (month_state.q28_quarterly(state), calendar.q28_quarterly(rows)),
            (month_state.q29_yearly(state), calendar.q29_yearly(rows)), (month_state.q31_mom_growth(state), calendar.q31_mom_growth(rows))]


def test_states_follow_late_and_repeated_appends(spark, scratch):
    bars_path, state_path = f"{scratch}/bars-{uuid.uuid4().hex}", f"{scratch}/state-{uuid.uuid4().hex}"
    rows = write_once(bars(spark, SF001), "rows")
    third = F.pmod(F.hash("TradeDate", "Ticker"), F.lit(3))
    for k in (2, 0, 0, 1):  # one of them twice
        month_state.append(spark, rows.where(third == k), bars_path, state_path)
    assert read_bars(spark, bars_path).count() == rows.count()
    for got, want in rollups(month_state.read_state(spark, state_path), rows):
        assert_df_equal(got, want)
    month_state.append(spark, rows.limit(0), bars_path, state_path)
    # The writer died between the rows and the states: the same batch again mends the states.
    late = rows.where("month(TradeDate) = 3").limit(4).withColumn("Ticker", F.lit("LATE"))
    write_bars(late, bars_path)
    month_state.append(spark, late, bars_path, state_path)
    for got, want in rollups(month_state.read_state(spark, state_path), rows.unionByName(late)):
        assert_df_equal(got, want)


def test_refresh_writes_only_touched_months(spark, scratch):
    bars_path, state_path = f"{scratch}/bars-{uuid.uuid4().hex}", f"{scratch}/state-{uuid.uuid4().hex}"
    write_bars(bars(spark, SF001), bars_path)
    stored = read_bars(spark, bars_path, extra=["Year"])
    month_state.refresh(stored, state_path)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(state_path) for f in fs if f.endswith(".parquet")}
    before = files()
    month_state.refresh(stored, state_path, [(1996, 2), (1997, 5)])
    changed = {re.search(r"Year=(\d+)/MonthNumber=(\d+)", f).groups() for f in before ^ files()}
    assert changed == {("1996", "2"), ("1997", "5")}
    year = month_state.p5_monthly_performance(month_state.read_state(spark, state_path), 1997)
    assert "PartitionFilters: [isnotnull(Year" in executed(year)
    assert_df_equal(year, calendar.p5_monthly_performance(bars(spark, SF001), 1997))


def test_split_range():
    d = dt.date
    assert month_state.split_range(d(2020, 1, 1), d(2020, 3, 31)) == ([], (2020 * 12, 2020 * 12 + 2))
    assert month_state.split_range(d(2020, 1, 2), d(2020, 3, 30)) == (
        [(d(2020, 1, 2), d(2020, 1, 31)), (d(2020, 3, 1), d(2020, 3, 30))], (2020 * 12 + 1, 2020 * 12 + 1))
    assert month_state.split_range(d(2020, 2, 5), d(2020, 2, 9)) == ([(d(2020, 2, 5), d(2020, 2, 9))], None)
    assert month_state.split_range(d(2019, 12, 15), d(2020, 1, 15)) == ([(d(2019, 12, 15), d(2020, 1, 15))], None)
    assert month_state.split_range(d(2019, 12, 31), d(2020, 2, 1))[1] == (2020 * 12, 2020 * 12)


@pytest.mark.parametrize("start,end", [((1996, 2, 10), (1998, 5, 3)), ((1997, 1, 1), (1997, 12, 31)), ((1997, 3, 3), (1997, 3, 9))])
def test_sliced_months_read_only_edge_days(spark, scratch, start, end):
    bars_path, state_path = f"{scratch}/bars-{uuid.uuid4().hex}", f"{scratch}/state-{uuid.uuid4().hex}"
    write_bars(bars(spark, SF001), bars_path)
    stored, markets = read_bars(spark, bars_path, extra=["Year"]), dim_market(spark, SF001)
    month_state.refresh(stored, state_path)
    state, lo, hi = month_state.read_state(spark, state_path), dt.date(*start), dt.date(*end)
    for slicer in ({}, {"countries": ["ASIA"]}, {"tickers": ["2-HIGH"]}):
        got = month_state.d21_slicer(state, stored, markets, lo, hi, **slicer)
        assert_df_equal(got, measures.d21_slicer(stored, markets, start=lo, end=hi, **slicer))
    edges, _ = month_state.split_range(lo, hi)
    assert sum((b - a).days + 1 for a, b in edges) <= 62
    plan = executed(month_state.sliced_months(state, stored, markets, lo, hi))
    assert len(re.findall(r"FileScan.*GreaterThanOrEqual\(TradeDate", plan)) == len(edges)


def test_kpis_of_no_rows(spark, odd_series):
    markets = dim_market(spark, SF001)
    for rows in (odd_series, odd_series.limit(0)):
        got = measures.d01_kpis(rows, markets).first()
        want = rows.join(markets.select("Ticker", "Country"), "Ticker", "left").agg(
            F.count_distinct("Country"), F.count_distinct("TradeDate"), F.max("ClosePrice"), F.min("ClosePrice"),
            F.sum("ClosePrice").cast("double") / F.nullif(F.count("ClosePrice"), F.lit(0)), F.sum("Volume")).first()
        assert tuple(got) == tuple(want)


# ---------------------------------------------------------------------- footers
@pytest.mark.parametrize("keyed", [True, False])
def test_footers_answer_counts_and_bounds(spark, scratch, keyed):
    path = f"{scratch}/bars-{uuid.uuid4().hex}"
    rows = write_once(bars(spark, SF001), "rows")
    write_bars(ingest.stored(rows) if keyed else rows, path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    for fn in (footers.q01_total_records, footers.q02_date_span):
        df = fn(spark, path)
        assert re.search(r"PushedAggregation: \[(COUNT|MIN)", executed(df)), fn.__name__
    assert footers.q01_total_records(spark, path).first()[0] == rows.count()
    assert not keyed or footers.last_price_id(spark, path) == rows.count()
    assert tuple(footers.q02_date_span(spark, path).first()) == tuple(rows.agg(F.min("TradeDate"), F.max("TradeDate")).first())
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


# --------------------------------------------------------------- profile and flatten
def test_profile_counts_repeated_rows_exactly(spark):
    """Rows with the same hash that differ (it skips NULLs) are no repeats."""
    rows = [(1, None, "a"), (None, 1, "a"), (2, 2, "b"), (2, 2, "b"), (2, 2, "b"), (None, None, None), (None, None, None), (3, 3, "c")]
    out = ingest.e06_profile(spark.createDataFrame(rows, "x int, y int, s string")).first()
    assert (out.Total_Rows, out.Total_Columns, out.Duplicated_Rows) == (8, 3, 3)
    assert (out.null_x, out.null_y, out.null_s) == (3, 3, 2) and (out.type_x, out.type_s) == ("INTEGER", "VARCHAR")
    empty = ingest.e06_profile(spark.createDataFrame([], "x int, s string")).first()
    assert (empty.Total_Rows, empty.Duplicated_Rows, empty.null_x) == (0, 0, 0)


def test_profile_shuffles_hashes_not_rows(spark):
    path = write_once(bars_wide(spark, SF001), "wide")
    p = executed(ingest.e06_profile(path))
    wide = [x for x in p.split("\n") if "Exchange hashpartitioning" in x]
    # Rows that share a hash are the only ones grouped by all columns.
    assert len(wide) == 1 and "BroadcastHashJoin" in p and "LeftSemi" in p


def test_flatten_gives_the_feed_rows(spark):
    wide = feed_wide(spark, SF001)
    assert_df_equal(ingest.e03_flatten(wide), feed(spark, SF001))
    p = executed(ingest.e03_flatten(write_once(wide, "vendor")))
    assert p.count("FileScan") == 1 and "Union" not in p


def test_flatten_of_uneven_columns(spark):
    wide = spark.createDataFrame(
        [(day(0), (1.0, 2.0), (5,)), (day(1), (None, 3.0), (None,)), (day(2), (None, None), (None,))],
        "Date date, Close struct<`^A`:double, `B.C`:double>, Volume struct<`^A`:bigint>")
    got = {(r["Date"], r["Ticker"]): (r["Close"], r["Volume"]) for r in ingest.e03_flatten(wide).collect()}
    assert got == {(day(0), "^A"): (1.0, 5), (day(0), "B.C"): (2.0, None), (day(1), "B.C"): (3.0, None)}
    with pytest.raises(ValueError):
        ingest.e03_flatten(wide.select("Date"))


# ---------------------------------------------------------------------- checked append
@pytest.fixture
def stored_path(spark, scratch):
    path = f"{scratch}/bars-{uuid.uuid4().hex}"
    write_bars(ingest.stored(write_once(bars(spark, SF001), "rows")), path)
    return path


def test_a_broken_constraint_fails_the_whole_append(spark, stored_path):
    table = read_bars(spark, stored_path, extra=["PriceID"])
    old = sorted(map(str, table.collect()))
    good = table.select(*BAR_COLUMNS).limit(3).withColumn("TradeDate", F.date_add("TradeDate", 20000))
    good = write_once(good, "good")
    known = table.select(*BAR_COLUMNS).where("Ticker = '2-HIGH'").orderBy("TradeDate").limit(1)
    key = str(known.first()["TradeDate"])
    faults = {rf"NULL in column ClosePrice, \(TradeDate, Ticker\) = \(\d": good.withColumn("ClosePrice", F.lit(None).cast("decimal(18,4)")),
              r"NULL in column TradeDate, \(TradeDate, Ticker\) = \(NULL, ": good.withColumn("TradeDate", F.lit(None).cast("date")),
              "key twice in the batch": good.unionByName(good.limit(1)), rf"key exists already, \(TradeDate, Ticker\) = \({key}, 2-HIGH\)": good.unionByName(known)}
    for message, batch in faults.items():
        with pytest.raises(Exception, match=message):
            append.append_checked(table, batch, stored_path)
        assert sorted(map(str, read_bars(spark, stored_path, extra=["PriceID"]).collect())) == old
    seen = append.append_checked(table, good, stored_path)
    assert seen["rows"] == 3 and seen["first"] == good.agg(F.min("TradeDate")).first()[0]
    after = read_bars(spark, stored_path, extra=["PriceID"])
    assert after.count() == len(old) + 3 and after.agg(F.count_distinct("PriceID"), F.max("PriceID")).first() == (len(old) + 3, len(old) + 3)


# ------------------------------------------------------------------- adjusted prices
def test_adjusted_prices(spark):
    D = __import__("decimal").Decimal
    rows = [(day(i), "A", "I", D(100), D(110), D(90), D(100 + i), 1000) for i in (0, 1, 2, 5, 6)] + \
           [(day(1), "B", "J", D(10), D(11), D(9), D(10), None)]
    b = spark.createDataFrame(rows, BAR)
    f = spark.createDataFrame([("A", day(2), 0.5, None), ("A", day(3), None, 0.9), ("A", day(6), 0.5, 0.8), ("A", day(9), 0.1, None)],
                              "Ticker string, ExDate date, SplitFactor double, DividendFactor double")
    got = {(r.Ticker, r.TradeDate): (float(r.ClosePrice), r.Volume) for r in adjust.adjusted(b, f).collect()}
    split = {0: 0.025, 1: 0.025, 2: 0.05, 5: 0.05, 6: 0.1}
    cash = {0: 0.72, 1: 0.72, 2: 0.72, 5: 0.8, 6: 1.0}
    assert got == {("B", day(1)): (10.0, None), **{
        ("A", day(i)): (pytest.approx((100 + i) * split[i] * cash[i], abs=1e-4), round(1000 / split[i])) for i in split}}
    some = adjust.adjusted(b, f, day(1), day(5))
    assert {(r.Ticker, r.TradeDate): float(r.ClosePrice) for r in some.collect()} == {
        k: v[0] for k, v in got.items() if day(1) <= k[1] < day(5)}
    plan = executed(adjust.adjusted(b, f, day(1), day(5)))
    assert plan.count("Window ") == 1 and "Join" not in plan
    assert_df_equal(adjust.adjusted(b, f.limit(0)), adjust.bounded(b))


def test_adjusted_volume_beyond_the_stored_type(spark):
    """Many splits make an early volume more than a bigint holds: that volume alone is NULL, and "double" holds it."""
    D = __import__("decimal").Decimal
    b = spark.createDataFrame([(day(k), "A", "I", D(8), D(8), D(8), D(8), 60_000) for k in (0, 30, 70, 2000)], BAR)
    f = spark.createDataFrame([("A", day(k), 0.5, None) for k in range(1, 71)], "Ticker string, ExDate date, SplitFactor double, DividendFactor double")
    want = {day(0): None, day(30): 60_000 << 40, day(70): 60_000, day(2000): 60_000}
    assert {r.TradeDate: r.Volume for r in adjust.adjusted(b, f).collect()} == want
    assert {r.TradeDate: r.Volume for r in adjust.adjusted(b, f, volume="double").collect()} == {**want, day(0): 60_000.0 * 2 ** 70}
    # So many halvings that their product is 0.
    f = spark.createDataFrame([("A", day(k), 0.5, None) for k in range(71, 1271)], f.schema)
    assert {r.TradeDate: r.Volume for r in adjust.adjusted(b, f).collect()} == {d: 60_000 if d == day(2000) else None for d in want}


# ----------------------------------------------------------------------- rankings
def test_rankings_plan_their_input_once(spark):
    b = bars_wide(spark, SF001)
    for fn in (measures.d03_best_worst, measures.d10_liquidity, measures.d14_risk_score, measures.d16_composite,
               measures.d17_ranking, measures.d18_insights):
        p = executed(fn(b))
        scans, exchanges = p.count("FileScan"), len(re.findall(r"(?<!Reused)Exchange (?!SinglePartition, REUSED)", p))
        assert scans <= 3 and exchanges <= 8, (fn.__name__, scans, exchanges)


def test_ranks_equal_plain_windows_on_odd_values(spark):
    """NULLs, NaN, infinities, both zeros and many ties; no rows, one row, NULLs only."""
    rnd = random.Random(1)
    odd = [None, 0.0, -0.0, 1.5, float("nan"), float("inf"), -float("inf")]
    rows = [(i, rnd.choice([*odd, float(rnd.randint(0, 5000))]), rnd.choice([None, 7.0])) for i in range(3000)]
    d = write_once(spark.createDataFrame(rows, "id int, a double, b double"), "values")
    from barlens.operators.ranking import with_percent_ranks, with_rank

    for part in (d, d.where("a is null"), d.limit(1), d.limit(0)):
        part = write_once(part, "part")
        got = with_percent_ranks(part, {"pa": "a", "pb": "b"}).select("id", "pa", "pb")
        want = part.select("id", F.percent_rank().over(Window.orderBy("a")).alias("pa"), F.percent_rank().over(Window.orderBy("b")).alias("pb"))
        assert_df_equal(got, want)
    plain = write_once(d.where("a is null or not isnan(a)"), "plain")
    assert_df_equal(with_rank(plain, "a", "r").select("id", "r"),
                    plain.select("id", F.rank().over(Window.orderBy(F.col("a").desc_nulls_last())).alias("r")))
