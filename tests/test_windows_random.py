"""Randomised check: blocked windows equal plain windows on arbitrary series."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barlens.operators import windows as W
from tests.helpers import assert_df_equal

SCHEMA = "s string, d date, v decimal(18,4)"

series = st.lists(
    st.tuples(st.sampled_from(["A", "B", "C"]),
              st.integers(min_value=0, max_value=40 * 365),        # day offset: up to 40 years
              st.one_of(st.none(), st.integers(min_value=-500, max_value=500))),
    min_size=1, max_size=120)


def _frame(spark, rows):
    seen, out = set(), []
    for s, off, v in rows:
        if (s, off) in seen:  # one row per (series, date): ROWS frames are then deterministic
            continue
        seen.add((s, off))
        out.append((s, dt.date(1980, 1, 1) + dt.timedelta(days=off), None if v is None else Decimal(v)))
    return spark.createDataFrame(out, SCHEMA)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=series, n=st.integers(min_value=2, max_value=30))
def test_blocked_equals_plain(spark, rows, n):
    df = _frame(spark, rows)
    outs = {"a": ("avg", "v", n), "sd": ("stddev", "v", n), "p": ("lag", "v")}
    assert_df_equal(W.with_sliding(df, "s", "d", outs, strategy="plain"),
                    W.with_sliding(df, "s", "d", outs, strategy="blocked"))
    specs = {"rs": ("sum", "v"), "rx": ("max", "v")}
    assert_df_equal(W.with_running(df, "s", "d", specs, strategy="plain"),
                    W.with_running(df, "s", "d", specs, strategy="blocked"))
    assert_df_equal(W.with_ranks(df, "s", "d", "rn", "rk", "dr", strategy="plain"),
                    W.with_ranks(df, "s", "d", "rn", "rk", "dr", strategy="blocked"))
