"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from marlstone.plans.standins import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return float(v)
    return str(v)[:10] if hasattr(v, "isoformat") else v


def _close(a, b) -> bool:
    return len(a) == len(b) and all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(y)) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = [tuple(_plain(x[names.index(c)]) for c in cols) for x in r.fetchall()]
    key = lambda x: tuple((v is None, round(v, 3) if isinstance(v, float) else v if isinstance(v, (int, bool)) else 0, str(v) if not isinstance(v, float) else "") for v in x)
    assert len(got) == len(want)
    assert all(_close(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Queries without SQL give rows, and numbers where they give any."""
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(not isinstance(v, float) or np.isfinite(v) for r in rows for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
