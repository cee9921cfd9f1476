"""Plan shape: pushdown, pruning, no needless shuffles."""

import datetime as dt
import os

from barlens.operators import calendar, ingest, measures, procedures, rolling, summary
from barlens.sources import bars, bars_wide, dim_market, read_bars, write_bars
from tests.conftest import SF001


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_reads_only_needed_columns(spark):
    p = bars(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    assert "o_custkey" not in p


def test_filters_reach_the_scan(spark, scratch):
    path = os.path.join(scratch, "bars")
    write_bars(bars(spark, SF001), path, mode="overwrite")
    b = read_bars(spark, path, extra=["Year"])
    p1 = procedures.p1_market_history(b, "2-HIGH")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Ticker), EqualTo(Ticker,2-HIGH)]" in p1
    lo, hi = dt.date(1999, 1, 1), dt.date(1999, 12, 31)
    markets = dim_market(spark, SF001)
    for df in (procedures.p2_market_by_date_range(b, lo, hi), calendar.p5_monthly_performance(b, 1999),
               measures.d21_slicer(b, markets, countries=["ASIA"], start=lo, end=hi),
               read_bars(spark, path, start=lo, end=hi)):
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(TradeDate,1999-01-01)" in p
        assert "PartitionFilters: [isnotnull(Year" in p and "(Year#" in p.split("PartitionFilters", 1)[1]


def test_files_do_not_grow_with_tasks(spark, scratch):
    counts = []
    for tasks in (2, 16):
        path = os.path.join(scratch, f"bars{tasks}")
        write_bars(bars(spark, SF001).repartition(tasks), path, mode="overwrite", buckets=2)
        counts.append({d: len([f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")])
                       for d in os.listdir(path) if d.startswith("Year=")})
    assert counts[0] == counts[1] and max(counts[0].values()) <= 2


def test_market_summary_reads_bars_once(spark):
    v6 = summary.v6_market_summary(bars(spark, SF001))._jdf.queryExecution().optimizedPlan().toString()
    assert v6.count("Join") == 1  # only the orders/lineitem join of the bar derivation


def aggregated(line):
    return any(x in line for x in ("Aggregate", "TakeOrderedAndProject", "CollectLimit"))


def test_rankings_send_no_table_to_one_task(spark):
    """What meets in one task is a partial aggregate or a bounded sample, never a window or sort of markets."""
    b = bars_wide(spark, SF001)
    for fn in (measures.d03_best_worst, measures.d09_volume_share, measures.d10_liquidity, measures.d14_risk_score,
               measures.d16_composite, measures.d17_ranking, measures.d18_insights, ingest.with_price_id):
        lines = fn(b)._jdf.queryExecution().executedPlan().toString().split("\n")
        singles = [i for i, x in enumerate(lines) if "Exchange SinglePartition" in x]
        assert all(aggregated(lines[i + 1]) or aggregated(lines[i + 2]) for i in singles), fn.__name__
        assert not any("Window" in x and ", []," in x for x in lines)


def test_kpis_and_drilldown_expand_small_tables(spark):
    b = bars(spark, SF001)
    p = measures.d19_drilldown(b)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in p.split("Expand", 1)[1].split("\n", 2)[1]
    # The distinct days are bits of a number: nothing is expanded.
    for df in (measures.d01_kpis(b, dim_market(spark, SF001)), calendar.q36_monthly_consistency(b)):
        assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_drilldown_expands_no_months(spark):
    """A task that expands months by every level holds several times its input as groups."""
    p = measures.d19_drilldown(bars_wide(spark, SF001))._jdf.queryExecution().optimizedPlan().toString()
    expanded = [x for x in p.split("\n") if "Expand" in x]
    assert expanded and not any("MonthNumber" in x or "_groupingexpression" in x for x in expanded)


def test_latest_snapshot_uses_group_limit(spark):
    p = procedures.p3_latest_snapshot(bars(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_contribution_broadcasts_the_date_totals(spark):
    p = plan(rolling.q46_contribution(bars(spark, SF001)))
    assert "BroadcastHashJoin" in p and "Window" not in p


def test_views_are_sql_addressable(spark):
    from barlens.plans.views import preview, register_views
    b = bars(spark, SF001)
    names = register_views(spark, b)
    assert "vw_MarketSummary" in names
    assert spark.sql("SELECT count(*) FROM vw_MarketSummary").first()[0] == 5
    p = spark.sql("SELECT * FROM vw_DailyPerformance WHERE Ticker = '2-HIGH'")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "EqualTo(o_orderpriority,2-HIGH)" in p  # the ticker filter reaches the orders scan
    top = preview(b, 3, ["TradeDate", "Ticker"], last=True).collect()
    assert len(top) == 3 and top[0].TradeDate >= top[-1].TradeDate


def test_market_dimension_from_mapping(spark):
    from barlens.sources.bars import dim_market_from
    m = dim_market_from(spark, {"T1": ("Index T1", "X"), "T2": ("Index T2", None)})
    assert sorted(r.Ticker for r in m.collect()) == ["T1", "T2"]


def test_procedures_as_sql_table_functions(spark):
    from barlens.operators import procedures as P
    from barlens.plans.views import register_procedures
    from tests.helpers import assert_df_equal
    b = bars(spark, SF001)
    register_procedures(spark, b)
    assert_df_equal(spark.sql("SELECT * FROM sp_GetMarketHistory('2-HIGH')"), P.p1_market_history(b, "2-HIGH"))
    assert_df_equal(spark.sql("SELECT * FROM sp_GetMarketByDateRange(DATE'1999-01-01', DATE'1999-12-31')"),
                    P.p2_market_by_date_range(b, dt.date(1999, 1, 1), dt.date(1999, 12, 31)))
    assert_df_equal(spark.sql("SELECT * FROM sp_GetTopPerformingMarkets(3)"), P.p4_top_markets(b, 3))
    assert spark.sql("SELECT * FROM sp_GetLatestMarketSnapshot()").count() == 5
    from barlens.operators import calendar as C
    assert_df_equal(spark.sql("SELECT * FROM sp_GetMonthlyPerformance(1999)"), C.p5_monthly_performance(b, 1999))
    assert spark.sql("SELECT * FROM sp_GetExecutiveSummary()").count() == 5
