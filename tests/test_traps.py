
import datetime as dt
from decimal import Decimal

import pytest

from barlens.operators import calendar, quality, returns, rolling, summary
from barlens.schema import BARS


def bar(d, t, close, vol=100, high=None, low=None, open_=None):
    c = Decimal(str(close))
    return (d, t, "Index " + t[0], Decimal(str(open_ if open_ is not None else close)),
            Decimal(str(high if high is not None else close)), Decimal(str(low if low is not None else close)),
            c, vol)


D = dt.date


@pytest.fixture(scope="module")
def micro(spark):
    rows = [
        bar(D(2020, 12, 30), "1-A", 10, vol=0),   # first row, zero volume at the start
        bar(D(2020, 12, 31), "1-A", 10, vol=5),   # equal close on the next day
        bar(D(2021, 1, 4), "1-A", 12, vol=7),     # change of year
        bar(D(2021, 1, 5), "1-A", 9, vol=0),
        bar(D(2021, 1, 6), "1-A", 9.9, vol=8),
        bar(D(2020, 12, 30), "2-B", 50, vol=1),   # a second ticker
        bar(D(2020, 12, 31), "2-B", 0.0001, vol=1),
        bar(D(2021, 1, 4), "2-B", 1, vol=1),
        bar(D(2021, 1, 4), "3-C", 5, vol=3),      # a ticker with one row
    ]
    return spark.createDataFrame(rows, BARS)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_t01_t11_daily_return_as_written_and_intended(micro):
    w = by(returns.v1_daily_performance(micro), "Ticker", "TradeDate")
    i = by(returns.v1_daily_performance_intended(micro), "Ticker", "TradeDate")
    first = w[("1-A", D(2020, 12, 30))]
    assert first.PreviousClose is None and first.DailyReturnPct is None
    assert first.MarketChange == "No Change"  # T11: both comparisons with NULL fail
    assert w[("1-A", D(2020, 12, 31))].MarketChange == "No Change"
    assert w[("1-A", D(2021, 1, 4))].DailyReturnPct == pytest.approx((12 - 1) * 100)  # (Close - 1) * 100
    assert i[("1-A", D(2021, 1, 4))].DailyReturnPct == pytest.approx(20.0)
    assert w[("1-A", D(2021, 1, 4))].MarketChange == "Up"
    assert w[("1-A", D(2021, 1, 5))].MarketChange == "Down"


def test_t22_small_previous_close_no_error(spark, micro):
    z = micro.union(spark.createDataFrame([bar(D(2021, 1, 5), "2-B", 0), bar(D(2021, 1, 6), "2-B", 3)], BARS))
    r = by(returns.q19_daily_performance(z), "Ticker", "TradeDate")
    assert r[("2-B", D(2021, 1, 6))].ClosePrice_change_pct is None  # previous close 0 -> NULL


def test_t06_worst_day_rank_two(micro):
    w = by(returns.q26_worst_day_per_index(micro), "IndexName")
    i = by(returns.q26_worst_day_per_index_intended(micro), "IndexName")
    # Ascending puts the NULL first-day return first, so rank 2 is the lowest return.
    assert w[("Index 2",)].TradeDate == D(2020, 12, 31)
    assert i[("Index 2",)].TradeDate == D(2020, 12, 31)
    assert ("Index 3",) not in w and ("Index 3",) in by(returns.q25_best_day_per_index(micro), "IndexName")


def test_t05_largest_change(micro):
    assert returns.q22_largest_change(micro).first().close_price_change == Decimal("2.0000")
    assert returns.q22_largest_change_intended(micro).first().close_price_change == Decimal("-49.9999")


def test_t13_rolling_volume_counts_traded_rows(micro):
    r = by(rolling.q41_rolling_volume7(micro), "IndexName", "TradeDate")
    assert ("Index 1", D(2020, 12, 30)) not in r
    assert r[("Index 1", D(2021, 1, 6))].RollingVolume7 == (5 + 7 + 8) // 3  # T08 truncation


def test_t17_running_volume_null_until_positive(micro):
    r = by(rolling.q38_running_volume(micro), "IndexName", "TradeDate")
    assert r[("Index 1", D(2020, 12, 30))].Running_Volume is None
    assert r[("Index 1", D(2021, 1, 6))].Running_Volume == 20


def test_t14_range_adds_peers(spark):
    rows = [bar(D(2021, 1, 4), "1-A", 1), bar(D(2021, 1, 4), "1-A", 2), bar(D(2021, 1, 5), "1-A", 4)]
    df = spark.createDataFrame(rows, BARS)
    got = sorted((r.TradeDate, r.RunningClosingPrice) for r in rolling.q37_running_close(df).collect())
    assert [v for _, v in got] == [Decimal("3.0000"), Decimal("3.0000"), Decimal("7.0000")]


def test_t24_moving_average_has_no_warm_up(micro):
    r = by(rolling.q39_ma7(micro), "IndexName", "TradeDate")
    assert r[("Index 1", D(2020, 12, 30))].seven_day_moving_average_closeprice == pytest.approx(10.0)
    assert r[("Index 1", D(2021, 1, 4))].seven_day_moving_average_closeprice == pytest.approx(32 / 3)


def test_t09_ties_go_to_the_first_name(spark):
    rows = [bar(D(2021, 1, 4), "2-B", 10), bar(D(2021, 1, 4), "1-A", 10)]
    df = spark.createDataFrame(rows, BARS)
    assert summary.q13_highest_close_index(df).first().IndexName == "Index 1"


def test_t18_lowest_high_price(micro):
    r = by(summary.q11_market_summary(micro), "Ticker")
    assert r[("1-A",)].lowest_high_price == Decimal("9.0000")


def test_t02_t03_quality_as_written_and_intended(spark):
    rows = [bar(D(2021, 1, 4), "1-A", 10, high=9, low=8, open_=9),   # bad high only
            bar(D(2021, 1, 5), "1-A", 10, high=11, low=10.5, open_=10.5),  # bad low only
            bar(D(2021, 1, 6), "1-A", 10, vol=-5)]
    df = spark.createDataFrame(rows, BARS)
    assert quality.q08_price_consistency(df).count() == 1
    assert quality.q08_price_consistency_intended(df).count() == 2
    assert quality.q09_zero_volume(df).count() == 0
    assert quality.q09_zero_volume_intended(df).count() == 1


def test_t07_yoy_is_a_fraction(micro):
    r = by(calendar.q30_yoy_growth(micro), "IndexName", "Yearr")
    p = by(calendar.q30_yoy_growth_intended(micro), "IndexName", "Yearr")
    assert p[("Index 1", 2021)].YoY_Growth_Pct == pytest.approx(100 * r[("Index 1", 2021)].YoY_Growth)


def test_renamed_index_has_the_tickers_latest_close(spark):
    rows = [(D(2020, 1, 1), "A", "Old", *[Decimal(1)] * 4, 1), (D(2020, 1, 2), "A", "New", *[Decimal(2)] * 4, 1)]
    out = {r.IndexName: r for r in summary.v6_market_summary(spark.createDataFrame(rows, BARS)).collect()}
    assert out["Old"].LatestClosePrice == 2 and out["New"].LatestClosePrice == 2
    assert out["Old"].LatestTradeDate == D(2020, 1, 1)


def test_market_without_country_keeps_its_row(spark, micro):
    from barlens.operators import measures
    markets = spark.createDataFrame([("1-A", "X"), ("2-B", "Y")], "Ticker string, Country string")
    for fn in (measures.d05_regional, measures.d12_volatility_by_country):
        assert {r.Country for r in fn(micro, markets).collect()} == {"X", "Y", None}
