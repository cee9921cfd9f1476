"""The blocked window strategy gives the same rows as the plain window."""

import datetime as dt
import random

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barlens.operators import windows as W
from barlens.sources import bars_wide
from tests.conftest import SF001
from tests.helpers import assert_df_equal

SCHEMA = "s string, d date, v decimal(18,4), n bigint"


def _edge_rows():
    rows = []
    # A: one or two rows a year for 31 years: blocks far smaller than a 30-row frame.
    for y in range(1990, 2021):
        rows.append(("A", dt.date(y, 1, 5), Decimal(str(y * 1.5)), y))
        if y % 2 == 0:
            rows.append(("A", dt.date(y, 7, 5), None, None))
    # B: a single row.
    rows.append(("B", dt.date(2000, 3, 1), Decimal("7"), 0))
    # C: daily rows across a year change.
    d0 = dt.date(1999, 12, 1)
    for i in range(60):
        rows.append(("C", d0 + dt.timedelta(days=i), Decimal(100 + (i * 37) % 11), (i * 13) % 5))
    return rows


def _dup_rows():
    # D: repeated dates (peers) for RANGE frames and ranks.
    rnd = random.Random(7)
    return [("D", dt.date(2001 + i // 12, 1 + (i // 3) % 4, 1), Decimal(rnd.randint(1, 50)), i)
            for i in range(40)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(_edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def dups(spark):
    return spark.createDataFrame(_dup_rows(), SCHEMA)


@pytest.fixture(scope="module")
def wide(spark):
    return bars_wide(spark, SF001).select(F.col("Ticker").alias("s"), F.col("TradeDate").alias("d"),
                                          F.col("ClosePrice").alias("v"), F.col("Volume").alias("n"))


def both(fn, df):
    return fn(df, "plain"), fn(df, "blocked")


@pytest.mark.parametrize("src", ["edge", "wide"])
def test_sliding(request, src):
    df = request.getfixturevalue(src)
    outs = {"a7": ("avg", "v", 7), "a30": ("avg", "v", 30), "i7": ("int_avg", "n", 7),
            "sd20": ("stddev", "v", 20), "prev": ("lag", "v")}
    a, b = both(lambda d, s: W.with_sliding(d, "s", "d", outs, strategy=s), df)
    assert_df_equal(a, b)


@pytest.mark.parametrize("src", ["edge", "wide"])
@pytest.mark.parametrize("frame", ["rows", "range"])
def test_running(request, src, frame):
    df = request.getfixturevalue(src)
    specs = {"s1": ("sum", "v"), "mx": ("max", "v"), "mn": ("min", "v"),
             "pos": ("sum", F.when(F.col("n") > 0, F.col("n")))}
    a, b = both(lambda d, s: W.with_running(d, "s", "d", specs, frame=frame, strategy=s), df)
    assert_df_equal(a, b)


def test_running_range_with_peers(dups):
    specs = {"s1": ("sum", "v"), "mx": ("max", "v")}
    a, b = both(lambda d, s: W.with_running(d, "s", "d", specs, frame="range", strategy=s), dups)
    assert_df_equal(a, b)


@pytest.mark.parametrize("src", ["edge", "wide"])
def test_ranks_and_first_last(request, src):
    df = request.getfixturevalue(src)
    a, b = both(lambda d, s: W.with_ranks(d, "s", "d", "rn", "rk", "dr", strategy=s), df)
    assert_df_equal(a, b)
    a, b = both(lambda d, s: W.with_first_last(d, "s", "d", "v", "f", "l", strategy=s)
                .select("s", "d", "v", "n", "f", "l"), df)
    assert_df_equal(a, b)


def test_ranks_with_peers(dups):
    a, b = both(lambda d, s: W.with_ranks(d, "s", "d", rank="rk", dense_rank="dr", strategy=s), dups)
    assert_df_equal(a, b)


def test_lag_matches_plain(edge):
    a, b = both(lambda d, s: W.with_lag(d, "s", "d", "v", "p", strategy=s), edge)
    assert_df_equal(a, b)


def test_blocked_plan_partitions_by_block(wide):
    plan = W.with_sliding(wide, "s", "d", {"a7": ("avg", "v", 7)}, strategy="blocked")._jdf \
        .queryExecution().executedPlan().toString()
    assert "_blk" in plan and "hashpartitioning(s#" in plan


def test_no_job_runs_at_construction(spark, wide):
    """Of windows. Rankings write their market table once when they are built, and count its value ranges."""
    from barlens.operators import measures, rolling
    bars_ = bars_wide(spark, SF001)
    group = "construction"
    spark.sparkContext.setJobGroup(group, group)
    try:
        for s in (None, "plain", "blocked"):
            W.with_running(wide, "s", "d", {"x": ("sum", "v")}, strategy=s)
            W.with_ranks(wide, "s", "d", "rn", "rk", "dr", strategy=s)
        rolling.q39_ma7(bars_)
        measures.d13_risk_table(bars_)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == []
        measures.d14_risk_score(bars_)
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 16
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _odd_rows():
    """NULL keys and dates, one index of two tickers with the same dates, ten years."""
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        d = dt.date(2001 + k // 6, 1 + k % 6 * 2, 3)
        for index, ticker in (("I", "A"), ("I", "B"), (None, "C"), ("J", "D")):
            rows.append((index, ticker, d, Decimal(rnd.randint(1, 90)), rnd.randint(0, 5)))
    return rows + [("I", "A", None, Decimal(7), 1), (None, "C", None, None, None)]


def test_null_keys_shared_index_and_shuffled_rows(spark):
    rows = _odd_rows()
    schema = "IndexName string, Ticker string, TradeDate date, v decimal(18,4), n bigint"
    frames = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        frames.append(spark.createDataFrame(rows, schema).repartition(5))
    outs = {"a3": ("avg", "v", 3), "p": ("lag", "v")}
    for build in (lambda d, s: W.with_sliding(d, "IndexName", "TradeDate", outs, strategy=s),
                  lambda d, s: W.with_running(d, "IndexName", "TradeDate", {"s1": ("sum", "v")}, strategy=s),
                  lambda d, s: W.with_running(d, "IndexName", "TradeDate", {"s1": ("sum", "v")}, "range", strategy=s),
                  lambda d, s: W.with_ranks(d, "IndexName", "TradeDate", "rn", "rk", "dr", strategy=s),
                  lambda d, s: W.with_first_last(d, "IndexName", "TradeDate", "v", "f", "l", strategy=s)):
        plain, blocked = both(build, frames[0])
        assert_df_equal(plain, blocked.select(*plain.columns))
        assert_df_equal(plain, build(frames[1], None))


def test_range_of_dates_sees_earlier_rows(spark):
    from barlens.operators import measures, returns, rolling
    b = bars_wide(spark, SF001)
    lo, hi = dt.date(1999, 3, 1), dt.date(1999, 3, 31)
    inside = F.col("TradeDate").between(F.lit(lo), F.lit(hi))
    for fn in (returns.v1_daily_performance, rolling.v2_moving_averages, measures.d11_rolling_vol20):
        assert_df_equal(fn(b, start=lo, end=hi), fn(b).filter(inside))
        assert_df_equal(fn(b, end=lo), fn(b).filter(F.col("TradeDate") <= F.lit(lo)))


def test_chained_frames_match_plain(edge):
    from barlens.operators.measures import _returns_and_volatility
    e = edge.withColumnRenamed("v", "ClosePrice")
    a, b = both(lambda d, s: W.with_frames(d, "s", "d", 20, _returns_and_volatility, strategy=s), e)
    assert_df_equal(a, b)
