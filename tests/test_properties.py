
import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from barlens.operators import measures, procedures, rolling
from barlens.sources import bars, bars_wide
from tests.conftest import SF001
from tests.helpers import assert_same


def test_running_extremes_bound_the_close(spark):
    b = bars_wide(spark, SF001)
    hi = rolling.q42_running_high(b)
    lo = rolling.q43_running_low(b)
    assert hi.filter(F.col("RunningHighestClose") < F.col("ClosePrice")).count() == 0
    assert lo.filter(F.col("RunningLowestClose") > F.col("ClosePrice")).count() == 0


def test_contributions_of_a_date_sum_to_100(spark):
    c = rolling.q46_contribution(bars(spark, SF001))
    s = c.groupBy("TradeDate").agg(F.sum("PercentageContribution").alias("t"))
    assert s.filter(F.abs(F.col("t") - 100) > 1e-9).count() == 0


def test_running_close_range_equals_rows_on_unique_keys(spark):
    b = bars(spark, SF001)
    q = rolling.q37_running_close(b).select("TradeDate", "IndexName", "RunningClosingPrice")
    v = rolling.v3_running_metrics(b).select("TradeDate", "IndexName", F.col("RunningClose"))
    j = q.join(v, ["TradeDate", "IndexName"])
    assert j.count() == b.count()
    assert j.filter(F.col("RunningClosingPrice") != F.col("RunningClose")).count() == 0


def test_latest_snapshot_one_row_per_ticker(spark):
    b = bars(spark, SF001)
    p = procedures.p3_latest_snapshot(b)
    latest = b.groupBy("Ticker").agg(F.max("TradeDate").alias("TradeDate"))
    assert p.count() == 5 and p.join(latest, ["Ticker", "TradeDate"]).count() == 5


def test_drilldown_grand_total(spark):
    b = bars(spark, SF001)
    d = measures.d19_drilldown(b)
    top = d.filter(F.col("Grouping_Level") == 15).first()
    assert top.Trading_Days == b.count() and top.Ticker is None


def test_drilldown_equals_brute_force(spark):
    """All levels, with null tickers, dates and values and repeated rows."""
    rows = [(d, t, c, v) for t in ("A", "B", None) for d, c, v in [
        (dt.date(1999, 1, 4), D("1.5"), 3), (dt.date(1999, 1, 4), D("1.5"), 3), (dt.date(1999, 2, 1), None, 4), (dt.date(1999, 7, 1), D("2"), None),
        (dt.date(2000, 12, 1), None, None), (None, D("7.25"), 5), (None, D("7.25"), 5)]]
    b = spark.createDataFrame(rows, "TradeDate date, Ticker string, ClosePrice decimal(18,4), Volume bigint").repartition(3)
    groups = {}
    for d, t, c, v in rows:
        keys = (t, *((d.year, (d.month + 2) // 3, d.month) if d else (None,) * 3))
        for n in range(5):
            groups.setdefault((keys[:n] + (None,) * (4 - n), 2 ** (4 - n) - 1), []).append((c, v))
    want = []
    for (keys, level), found in groups.items():
        close, volume = [c for c, _ in found if c is not None], [v for _, v in found if v is not None]
        want.append((*keys, level, len(found), float(sum(close)) / len(close) if close else None, sum(volume) if volume else None))
    d = measures.d19_drilldown(b)
    assert_same(d.columns, [tuple(r) for r in d.collect()], d.columns, want)
    assert measures.d19_drilldown(b.limit(0)).count() == 0


def test_composite_scores_are_bounded(spark):
    c = measures.d16_composite(bars_wide(spark, SF001))
    r = c.agg(F.min("Composite_Score"), F.max("Composite_Score"), F.count("*")).first()
    assert 0 <= r[0] <= r[1] <= 100 and r[2] == 200
