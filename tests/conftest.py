import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def spark():
    from barlens.session import build_session
    # One machine: a scratch folder can stand for the shared one.
    shared = tempfile.mkdtemp(prefix="barlens-shared-")
    s = build_session("local[*]", 8, app_name="barlens-tests", extra={"spark.checkpoint.dir": shared})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="barlens-test-")
