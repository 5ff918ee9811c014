from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kindred.sources.session import local_session

    return local_session("kindred-tests")


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over a folder of tables and compares columns and rows."""
    import duckdb

    def run(query, sql, folder=SMALL):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        want = con.execute(sql)
        names = sorted(x[0] for x in want.description)
        order = [[x[0] for x in want.description].index(n) for n in names]
        wanted = sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
        df = query(spark, folder)
        assert sorted(df.columns) == names
        assert sorted(repr([plain(r[n]) for n in names]) for r in df.collect()) == wanted

    return run
