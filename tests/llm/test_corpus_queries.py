"""The operators' queries against their SQL, over whole small tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from spreadlake.llm.queries import ORACLES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    key = next(c for c in ("vec_id", "conv_id", "doc_id") if c in got.columns)
    got, want = (x.sort_values(key).reset_index(drop=True)[sorted(got.columns)] for x in (got, want))
    assert len(got) == len(want) and (got == want).all().all()


def test_entry_works_without_the_folder():
    import subprocess

    code = (
        "import sys; sys.modules['spreadlake.llm'] = None; "
        "import importlib.util as u; found = u.find_spec; u.find_spec = lambda n, *a: None if n == 'spreadlake.llm' else found(n, *a); "
        "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
