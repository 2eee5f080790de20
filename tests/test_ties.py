"""Queries whose rounded values lie halfway between two results, bit for bit against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from marlstone.functions import rounded, steady_mean
from marlstone.operators.ranks import exact_quantile
from marlstone.plans.standins import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def _halves(d, surface: int):
    """Sales of whole cents and units of one surface: of 32, prices for a unit have seven decimals, the last a 5."""
    c = duckdb.connect()
    own = {"orders": "* REPLACE (o_orderkey * 90 + 12 AS o_orderkey)", "lineitem": f"* REPLACE (l_orderkey * 90 + 12 AS l_orderkey, {surface}.0::DOUBLE AS l_quantity)"}
    for t in ("orders", "lineitem", "customer", "nation"):
        c.execute(f"COPY (SELECT {own.get(t, '*')} FROM '{SF}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT PARQUET)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def _rows(rows, cols, names) -> list:
    return sorted(tuple(str(r[names.index(c)])[:10] if hasattr(r[names.index(c)], "isoformat") else r[names.index(c)] for c in cols) for r in rows)


@pytest.mark.parametrize(("name", "surface"), [("a03_price_sqm_all", 32), ("a03_price_sqm_house", 32), ("a08_land_price", 32), ("g05_time_adjusted", 32), ("t01_a38_national_quarters", 96)])
def test_rounds_as_its_sql(spark, tmp_path, name, surface):
    c = _halves(tmp_path, surface)
    df, want = QUERIES[name](spark, str(tmp_path)), c.execute(SQL[name])
    cols = [x[0] for x in want.description]
    assert _rows(df.collect(), cols, df.columns) == _rows(want.fetchall(), cols, cols)


def test_rounded_halves(spark):
    x = pd.DataFrame({"x": np.concatenate([np.arange(-3201, 3201) / 3200, 8399.8178125 + np.arange(2000) / 64])})
    got = spark.createDataFrame(x).select("x", rounded(F.col("x"), 6).alias("r")).toPandas()
    want = dict(duckdb.sql("SELECT x, round(x, 6) FROM x").fetchall())
    assert (got.r == got.x.map(want)).all()


@pytest.mark.parametrize("accuracy", [1, 10_000])
def test_medians_to_the_last_bit(spark, accuracy):
    """As quantile_cont, in groups ranked by bins and whole, also between values far apart."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame([(g, v) for g in range(200) for v in np.round(rng.lognormal(8, 2, 2 + g % 3), 2) / 7], columns=["g", "v"])
    got = {r["g"]: r["quantile"] for r in exact_quantile(spark.createDataFrame(rows), ["g"], "v", accuracy=accuracy).collect()}
    assert got == dict(duckdb.sql("SELECT g, quantile_cont(v, 0.5) FROM rows GROUP BY g").fetchall())


def test_mean_whatever_the_order(spark):
    """Cents whose exact mean lies halfway."""
    rng = np.random.default_rng(4)
    cents = rng.integers(10_000, 50_000_000, 9600)
    cents[0] += 96 * 50_000 + 12 - cents.sum() % (96 * 100_000)  # 9600 * 100 times the mean ends in ...12.5 of a millionth
    for order in (cents, np.sort(cents), np.sort(cents)[::-1]):
        df = spark.createDataFrame(pd.DataFrame({"x": order / 100}))
        assert df.coalesce(1).agg(steady_mean(F.col("x"))).first()[0] == int(cents.sum()) / 960_000
    odd = spark.createDataFrame([(1.5,), (None,), (float("inf"),)], "x double")
    assert odd.agg(steady_mean(F.col("x"))).first()[0] == float("inf") and odd.where("x < 2 or x is null").agg(steady_mean(F.col("x"))).first()[0] == 1.5
