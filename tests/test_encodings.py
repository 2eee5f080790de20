"""Categories of any number, and intervals whose coverage is measured on rows that set no margin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import models as M


def test_a_hundred_codes(spark):
    """A label that hangs on a hundred codes without order: statistics beat the code's number, and no train row sees its own label."""
    rng = np.random.default_rng(4)
    level = rng.permutation(100) * 10.0
    rows = [(i, f"d{i % 100:03d}", float(i % 100), "train" if i // 100 % 5 else "test", float(level[i % 100] + rng.normal())) for i in range(3000)]
    df = spark.createDataFrame([*rows, (3000, None, -1.0, "train", 500.0), (3001, "new", -1.0, "test", 490.0)], "id int, dept string, number double, split string, y double").cache()
    assert M.wide_categories(df, ["dept"]) == ["dept"] and M.wide_categories(df, ["split"]) == []
    native = M.boosted(df, "y", ["dept"], [], one_hot=False, iterations=10)
    plain = M.boosted(df, "y", [], ["number"], iterations=10)
    mae = lambda m: M.regression_report(m.transform(df.where("split = 'test'")), "y", "prediction").first()["mae"]
    assert mae(native) < 0.5 * mae(plain)
    fitted = M.TargetStatistics(["dept"], "y").fit(df.where("split = 'train'"))
    got = fitted.transform(df).select("id", "dept", "split", "y", "dept_stat", M._fold(df, ["dept"], "y", 5).alias("fold")).collect()
    train = [r for r in got if r["split"] == "train"]
    mean = np.mean([r["y"] for r in train])
    for r in [*got[:40], *got[-2:]]:
        use = [x["y"] for x in train if x["dept"] == r["dept"] and (r["split"] == "test" or x["fold"] != r["fold"])]
        assert r["dept_stat"] == pytest.approx((sum(use) + 20 * mean) / (len(use) + 20))
    table = {r["encoding"]: r for r in M.encodings_compared(df, "y", ["dept"], [], 5).collect()}
    assert set(table) == {"dummies", "categories"} and table["categories"]["mae"] < table["dummies"]["mae"]


def test_coverage_on_rows_that_set_no_margin(spark):
    """Skewed errors have unequal margins; later rows lie within about as often as promised."""
    panel = spark.range(6000).select((F.col("id") % 100).alias("geo"), F.floor(F.col("id") / 100).cast("int").alias("t"), (100 + 10 * F.rand(3)).alias("price"))
    panel = panel.withColumn("period", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t"))).withColumns({"target_1": F.col("price") + F.exp(F.randn(4)), "period_1": F.date_add("period", 1)}).cache()
    first, later = F.to_date(F.lit("2024-01-20")), F.to_date(F.lit("2024-02-10"))
    fitted = M.horizon_models(panel, (1,), ["price"], first, iterations=5)
    report = M.calibrated_report(fitted, panel, first, later)
    r = report.first()
    assert r["n_calibrated"] == panel.where(F.col("period_1").between(first, F.date_sub(later, 1))).count() and r["n"] == panel.where(F.col("period_1") >= later).count()
    assert abs(r["coverage"] - 0.8) < 0.04 and r["margin_high"] > 1.3 * r["margin_low"]
    f = M.forecast_ranges(fitted, panel.where("t = 59"), report).first()
    assert f["high_1"] - f["forecast_1"] == pytest.approx(r["margin_high"]) and f["forecast_1"] - f["low_1"] == pytest.approx(r["margin_low"])


def test_quantiles_of_leaves(spark):
    """One tree's leaf gives the quantiles of its targets; a forest's intervals hold what they say on rows not trained on."""
    rng = np.random.default_rng(7)
    x, e = rng.uniform(0, 10, 3000), rng.lognormal(size=3000)
    df = spark.createDataFrame([(i, float(a), float(50 + 10 * a + b)) for i, (a, b) in enumerate(zip(x, e, strict=True))], "id int, x double, y double").cache()
    one = M.forest_quantiles(df, df, "y", ["x"], [0.1, 0.5, 0.9], trees=1, depth=0).collect()
    y = 50 + 10 * x + e
    ranks = [np.searchsorted(np.sort(y), one[0][c]) / len(y) for c in ("q10", "q50", "q90")]
    assert ranks == pytest.approx([0.1, 0.5, 0.9], abs=0.04) and len({(r["q10"], r["q90"]) for r in one}) == 1  # a tree draws its own rows, the targets are all
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    got = M.forest_quantiles(train, test, "y", ["x"], [0.1, 0.5, 0.9], trees=10).collect()
    inside = np.mean([r["q10"] <= r["y"] <= r["q90"] for r in got])
    assert len(got) == 1000 and 0.74 < inside < 0.9 and all(r["q10"] <= r["q50"] <= r["q90"] for r in got)
