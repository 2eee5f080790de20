"""Quantiles within a bracket against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators.ranks import exact_quantile


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles(spark, accuracy):
    """A coarse sketch makes the bracket leave values out on both sides; ties, one value, nulls and null groups."""
    rng = np.random.default_rng(5)
    groups = {"wide": rng.lognormal(size=5001), "even": rng.normal(size=4000), "ties": rng.integers(0, 3, 3000) * 1.0, "one": np.array([7.0]), "two": np.array([1.0, 4.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("wide", None), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in exact_quantile(df, ["g"], "v", accuracy=accuracy).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k]["n"] == len(x) and got[k]["quantile"] == pytest.approx(np.quantile(x, 0.5))
    upper = {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "v", upper=True, accuracy=accuracy).collect()}
    assert upper == {k: float(np.sort(x)[len(x) // 2]) for k, x in groups.items()}
    tail = {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "v", 0.9, accuracy=accuracy).collect()}
    assert all(tail[k] == pytest.approx(np.quantile(x, 0.9)) for k, x in groups.items())


def test_without_groups_and_empty(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert exact_quantile(df, [], "v").first()["quantile"] == 500.0
    assert exact_quantile(df.where("v < 0").withColumn("g", F.lit(1)), ["g"], "v").count() == 0
