"""Registered queries against their oracle. FEW_QUERIES=1 runs a dozen of them."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
FAST = [
    "flagship_latest_spreads", "a07_page_links", "b09_series_profile", "c01_unit_refusals", "d07_linear_between_anchors",
    "e13_specification_aware_disagreement", "f09_longest_run", "g01_carrier", "i02_final_beats_provisional", "j18_scenario_grid",
    "l05_season_claims", "m02_event_coverage", "o02_streaming_vintage_upsert",
]
# the corpus queries have tests of their own, which go where their folder goes
NAMES = FAST if os.environ.get("FEW_QUERIES") else sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    assert rows_of(got) == rows_of(con.execute(sql).df())


def test_queries_load_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=60)
