"""Codes of registers without districts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.plans import place_queries  # noqa: F401  (registers the queries)
from marlstone.plans.standins import QUERIES, SQL
from marlstone.sources import readers as I


@pytest.mark.parametrize("name", ["s07_a23_measure_rows", "s08_retail"])
def test_keys_like_districts_and_long_ones(spark, tmp_path, name):
    """Keys in the districts' ranges stay, six digits are cut to five as by lpad."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT k::BIGINT AS c_custkey, k / 8.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM (VALUES (7), (13201), (13216), (69385), (75120), (99999), (132015), (900001)) v(k)) TO '{tmp_path}/customer.parquet' (FORMAT PARQUET)")
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    df, want = QUERIES[name](spark, str(tmp_path)), c.execute(SQL[name])
    cols = [x[0] for x in want.description]
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.fetchall())


def test_districts_are_folded_unless_told(spark):
    rows = spark.createDataFrame([("13201", "COM", "M", "2.5")], "GEO string, GEO_OBJECT string, MEASURE string, OBS_VALUE string")
    wide = rows.select(F.col("GEO").alias("DEPCOM"), F.lit("D").alias("DOM"), F.lit("S").alias("SDOM"), F.col("OBS_VALUE").alias("NB_EQUIP"))
    assert [I.measure_rows(rows, "M").first()["city"], I.retail(wide).first()["city"]] == ["13055"] * 2
    assert [I.measure_rows(rows, "M", districts=()).first()["city"], I.retail(wide, districts=()).first()["city"]] == ["13201"] * 2
