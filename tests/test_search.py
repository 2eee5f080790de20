"""The search of boosted trees by halving rounds, and feature levels with gaps."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from marlstone.operators import models as M

GRID = {"maxDepth": (1, 3), "maxIter": (2, 4), "stepSize": (0.3,)}


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(300).select("id", F.rand(5).alias("a"), F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("c"))
    r = r.withColumn("y", F.when(F.col("id") % 50 != 7, 10 * F.col("a") + F.when(F.col("c") == "y", 5).otherwise(0)))
    return M.split_by_hash(r, "id").cache()


def test_rounds_keep_the_better_part(spark, rows):
    """Every round's kept rows have the least errors; the last round's errors are those of plain fits; the best one is returned."""
    model, report = M.random_search(rows, "y", ["c"], ["a"], candidates=9, folds=2, rounds=2, rate=2, grid=GRID)
    told = [r.asDict() for r in report.collect()]
    first, last = ([r for r in told if r["round"] == k] for k in (0, 1))
    assert len(first) == 4 and len({(r["maxDepth"], r["maxIter"]) for r in first}) == 4  # the whole grid, once each
    assert all(r["trees"] == r["maxIter"] / 2 for r in first) and all(r["trees"] == r["maxIter"] for r in last)
    kept = sorted(first, key=lambda r: (r["mae"], r["candidate"]))[:2]
    assert {r["candidate"] for r in kept} == {r["candidate"] for r in first if r["kept"]} == {r["candidate"] for r in last}
    best = min(last, key=lambda r: (r["mae"], r["candidate"]))
    assert [r["candidate"] for r in last if r["kept"]] == [best["candidate"]]
    assert (model.stages[-1].getNumTrees, model.stages[-1].getOrDefault("maxDepth")) == (best["maxIter"], best["maxDepth"])
    train = rows.where("split = 'train' and y is not null")
    t = Pipeline(stages=M.design(["c"], ["a"])).fit(train).transform(train.withColumn("fold", M._fold(train, ["c"], "y", 2)))
    for r in last:
        errors = []
        for k in (0, 1):
            fit = GBTRegressor(labelCol="y", maxBins=64, seed=M.SEED, maxDepth=int(r["maxDepth"]), maxIter=int(r["maxIter"]), stepSize=0.3).fit(t.where(F.col("fold") != k))
            errors.append(fit.transform(t.where(F.col("fold") == k)).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0])
        assert r["mae"] == pytest.approx(sum(errors) / 2, rel=1e-9) and r["folds"] == 2


def test_candidates_are_drawn_once_and_again_the_same():
    few = M.drawn(20)
    assert len({tuple(c.values()) for c in few}) == 20 and few == M.drawn(20) and few != M.drawn(20, seed=1)
    assert len(M.drawn(99, GRID)) == 4


def test_search_needs_rows_and_takes_equal_ones(spark, rows):
    """No complete train row is an error; rows that are all equal share a fold, so nothing is compared and the first drawn stays."""
    with pytest.raises(ValueError, match="no complete"):
        M.random_search(rows.where("y is null"), "y", ["c"], ["a"], grid=GRID)
    same = spark.range(8).select(F.lit("x").alias("c"), F.lit(1.0).alias("a"), F.lit(2.0).alias("y"), F.lit("train").alias("split"))
    model, report = M.random_search(same, "y", ["c"], ["a"], candidates=2, rounds=1, grid=GRID)
    told = report.collect()
    assert [(r["mae"], r["folds"], r["kept"]) for r in told] == [(None, 0, True), (None, 0, False)]
    assert model.transform(same).first()["prediction"] == pytest.approx(2.0)


def test_levels_meet_the_same_rows(spark):
    """Gaps of imputed columns lose no row and tell by their flag from level 1 on; rows that lack another column are in no level."""
    rows = spark.range(900).select("id", (F.col("id") % 3).cast("string").alias("dept"), F.rand(1).alias("a"), F.when(F.col("id") % 5 != 0, F.rand(2)).alias("b"), F.when(F.col("id") % 90 != 1, F.rand(3)).alias("c"))
    rows = M.split_by_hash(rows.withColumn("y", F.when(F.col("b").isNull(), 10.0).otherwise(F.lit(0.0)) + F.col("a")), "id")
    got = {r["level"]: r for r in M.ablation(rows, "y", {0: ("a",), 1: ("b",), 2: ("c",)}, iterations=5, imputed=("b",)).collect()}
    test = [r for r in rows.where("split = 'test'").collect() if r["c"] is not None]
    assert [got[k]["features"] for k in (0, 1, 2)] == [1, 3, 4]
    assert {got[k]["n"] for k in (0, 1, 2)} == {len(test)}
    assert got[1]["mae"] < 0.2 * got[0]["mae"]
