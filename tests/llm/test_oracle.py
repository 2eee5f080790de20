"""The operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from marlstone.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    r = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(x[names.index(k)] for k in sorted(names)) for x in r.fetchall())
    assert sorted(tuple(x[k] for k in sorted(names)) for x in df.collect()) == want
