"""Rejects counted in one pass, followers of missing steps, upserts that failed, weighted quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import quality as Q
from marlstone.operators import ranks as R
from marlstone.sources import readers as I
from marlstone.sources import sinks as O


def test_quarantine(spark, tmp_path):
    """Every line is kept or has its first reason, and the source is read once."""
    (tmp_path / "a.csv").write_text("city,rate\n01001,5.5\n01002,abc\n01003,900\n,7\n01004\n")
    (tmp_path / "b.csv").write_text("city,rate\n02001,1\n02002,-3\n")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        reads.add(1)
        return True

    checks = {"no city": F.col("city").isNotNull(), "out of band": F.col("rate").between(0, 250) & seen("city")}
    good, bad, counts = I.quarantined_csv(spark, str(tmp_path), "city string, rate double", checks, header=True)
    assert {(r["city"], r["rate"]) for r in good.collect()} == {("01001", 5.5), ("02001", 1.0)} and good.columns == ["city", "rate"]
    got = {(r["file"], r["reason"], r["line"]) for r in bad.collect()}
    assert got == {("a.csv", "unreadable", "01002,abc"), ("a.csv", "out of band", None), ("a.csv", "no city", None), ("a.csv", "unreadable", "01004"), ("b.csv", "out of band", None)}
    assert counts == {"rows": 7, "kept": 2, "unreadable": 2, "no city": 1, "out of band": 2}
    assert reads.value <= 7


def test_followers(spark):
    """A chain of three, a fork, a circle, and steps that nothing leads to."""
    follows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("y", "z"), ("p", "q"), ("q", "p")], "name string, follower string")
    missing = spark.createDataFrame([("a",), ("x",), ("p",), ("lone",)], "name string")
    assert {r["name"]: r["distance"] for r in Q.with_followers(missing, follows).collect()} == {"a": 0, "b": 1, "x": 0, "c": 1, "d": 2, "p": 0, "q": 1, "lone": 0}
    assert Q.with_followers(missing.limit(0), follows).count() == 0


def test_upsert_leaves_no_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, value double, part string, written_at int")
    O.replace_partitions(rows((1, 1.0, "a", 1), (2, 2.0, "b", 1)), path, ["part"])
    O.upsert_parquet(spark, path, rows((1, 5.0, "a", 2), (3, 3.0, "a", 2)), ["id"], "part")
    read = lambda: {(r["id"], r["value"]) for r in spark.read.parquet(path).collect()}
    assert read() == {(1, 5.0), (2, 2.0), (3, 3.0)} and [p.name for p in tmp_path.iterdir()] == ["t"]
    rows((2, 9.0, "b", 3)).write.parquet(f"{path}_staged_1")  # a run that ended before its rows were in place
    (tmp_path / "t_staged_2").mkdir()  # and one that ended before they were merged
    O.upsert_parquet(spark, path, rows((4, 4.0, "c", 4)), ["id"], "part")
    assert read() == {(1, 5.0), (2, 9.0), (3, 3.0), (4, 4.0)} and [p.name for p in tmp_path.iterdir()] == ["t"]


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_weighted_and_several(spark, accuracy):
    """Groups ranked whole and in bins: several quantiles and weighted ones equal numpy's; ties, zero weights, one row, nulls."""
    rng = np.random.default_rng(1)
    groups = {"wide": rng.lognormal(size=3000), "ties": rng.integers(0, 4, 900) * 1.0, "one": np.array([3.0]), "skew": np.concatenate([np.zeros(500), rng.normal(size=500)])}
    rows = [(k, float(v), float(rng.integers(0, 5)) if k != "one" else 2.0) for k, x in groups.items() for v in x]
    df = spark.createDataFrame([*rows, ("wide", None, 1.0), ("wide", 1.0, None), (None, 1.0, 1.0)], "g string, v double, w double").repartition(6)
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in R.exact_quantiles(df.where("w is not null"), ["g"], "v", qs, accuracy=accuracy).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k]["quantiles"] == pytest.approx(np.quantile(x, qs)) and got[k]["n"] == len(x)
    got = {r["g"]: r["quantiles"] for r in R.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 1.0], "w", accuracy=accuracy).collect()}
    for k in groups:
        v, w = np.array([(v, w) for g, v, w in rows if g == k]).T
        order = np.argsort(v, kind="stable")
        v, run = v[order], np.cumsum(w[order])
        assert got[k] == [v[np.flatnonzero(run >= q * run[-1])[0]] for q in (0.25, 0.5, 1.0)]
    wide = R.medians(df.withColumn("v2", F.col("v") * 2), [], ["v", "v2"]).first()
    assert wide["v2"] == pytest.approx(2 * wide["v"])
