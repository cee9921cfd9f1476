"""The correctness gate: every registered key against its DuckDB statement at sf0.01."""

import pytest

import __spark_entry__ as E
from barlens.plans import catalog
from tests.conftest import SF01
from tests.helpers import assert_same

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_every_key_has_an_oracle():
    """Of this library; text operators that SQL cannot express have tests of their own."""
    assert set(catalog.queries()) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_key_matches_duckdb(spark, duck, key):
    df = QUERIES[key](spark, SF01)
    cur = duck.execute(ORACLES[key])
    assert_same(df.columns, [tuple(r) for r in df.collect()],
                [d[0] for d in cur.description], cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns[:3] == ["Ticker", "IndexName", "TradingDays"]
