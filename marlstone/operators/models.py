"""Clustering, price, forecast, interval and yield models on MLlib, with their metrics."""

from __future__ import annotations

import itertools
import math
import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import ratio
from marlstone.operators.clusters import Fit, hashed_first, kmeans_fits, silhouettes, soft_clusters, split_clusters  # noqa: F401  (soft and split clusters belong to the models)
from marlstone.operators.ranks import exact_quantile, exact_quantiles
from marlstone.operators.staging import staged
from marlstone.operators.windows import group_fill

SEED = 42
#: Categories of a column that trees take as such; a column with more becomes statistics of the label.
NATIVE = 32
#: Feature levels as cumulative sets (M-17).
FEATURE_LEVELS = {
    0: ("population", "density", "vacancy", "unemployment"),
    1: ("median_income", "owner_share", "secondary_share"),
    2: ("km_to_city", "km_to_capital", "house_share", "mean_surface"),
    3: ("poi_per_1000", "student_share", "retired_share"),
}


def features_up_to(level: int, levels: dict[int, tuple[str, ...]] | None = None) -> list[str]:
    levels = FEATURE_LEVELS if levels is None else levels
    return [f for k in sorted(levels) if k <= level for f in levels[k]]


def observed(rows: DataFrame, source: str = "source") -> DataFrame:
    """Rows whose value is not estimated; an unknown source counts as observed (P-22)."""
    return rows.where(~F.col(source).eqNullSafe("estimated"))


def complete_cases(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all columns, and the dropped ones (P-21)."""
    missing = F.lit(False)
    for c in columns:
        missing |= F.col(c).isNull()
    return rows.where(~missing), rows.where(missing)


def prepared(rows: DataFrame, columns: list[str], skewed: list[str] | None = None, out: str = "scaled") -> DataFrame:
    """Complete cases, log1p of skewed columns, standardised vector with the population deviation (M-01)."""
    clean, _ = complete_cases(rows, columns)
    logs = {f"_f_{c}": F.log1p(c) if c in (skewed or []) else F.col(c).cast("double") for c in columns}
    clean = clean.withColumns(logs)
    s = clean.agg(*[x for c in columns for x in (F.avg(f"_f_{c}").alias(f"_m_{c}"), F.stddev_pop(f"_f_{c}").alias(f"_s_{c}"))])
    z = clean.crossJoin(F.broadcast(s)).withColumns({f"_f_{c}": F.coalesce((F.col(f"_f_{c}") - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    z = VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol=out).transform(z)
    return z.drop(*[f"{p}{c}" for c in columns for p in ("_f_", "_m_", "_s_")])


def scaled_vector(rows: DataFrame, vector: str, out: str = "scaled") -> DataFrame:
    return StandardScaler(inputCol=vector, outputCol=out, withMean=True, withStd=True).fit(rows).transform(rows)


def scan_k(rows: DataFrame, ks: list[int], features: str = "scaled", seed: int = SEED, starts: int = 10) -> list[tuple[int, float, float]]:
    """k, cost and silhouette (on at most 5,000 rows) of each, all fits side by side (M-02)."""
    fits = kmeans_fits(rows, ks, starts, features=features, seed=seed)
    wide = silhouettes(rows, [f for f in fits if f.k > 1], features)
    return [(f.k, f.cost, wide.get(f.k, float("nan"))) for f in fits]


def best_kmeans(rows: DataFrame, k: int, starts: int = 10, features: str = "scaled", seed: int = SEED) -> Fit:
    """The fit with the lowest cost of several starts."""
    return kmeans_fits(rows, [k], starts, features=features, seed=seed)[0]


def anova_f(rows: DataFrame, group: str, values: list[str], least: int = 1) -> DataFrame:
    """feature, f, groups, n of a one-way analysis of variance (M-03, M-04): sums of each feature and group, any number of features."""
    each = rows.select(F.col(group).alias("_g"), F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("v")) for v in values])).alias("p")).select("_g", "p.*")
    g = each.groupBy("feature", "_g").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    t = g.where(F.col("n") >= least).groupBy("feature").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return t.select("feature", ((between / (F.col("groups") - 1)) / (within / (F.col("n") - F.col("groups")))).alias("f"), "groups", "n")


def f_weights(tested: DataFrame) -> DataFrame:
    """feature, weight: the F values over their mean (M-03)."""
    mean = F.avg("f").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row for each feature
    return tested.select("feature", (F.col("f") / mean).alias("weight"))


def weighted_vector(rows: DataFrame, weights: list[float], features: str = "scaled", out: str = "weighted") -> DataFrame:
    """Each dimension times the root of its weight, for a refit."""
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    return ElementwiseProduct(scalingVec=Vectors.dense([math.sqrt(w) for w in weights]), inputCol=features, outputCol=out).transform(rows)


def representatives(rows: DataFrame, model: Fit, features: str = "scaled", key: str = "id", n: int = 8) -> DataFrame:
    """The n members nearest to the centre of each cluster (W-18)."""
    rank = F.row_number().over(Window.partitionBy("prediction").orderBy("distance", key))
    rows = rows.withColumn("prediction", model.column(features))
    return rows.withColumn("distance", model.distance(features, F.col("prediction"))).withColumn("rank", rank).where(F.col("rank") <= n)


class TargetStatistics(Estimator):
    """Mean label of each category, drawn to the mean of all by ``prior`` rows, as a number (M-10, M-18).

    Train rows get the mean without the rows of their own fold, so that no row
    sees its label; all others, and categories not met, get that of all train
    rows.  Any number of categories; nulls are one of their own.
    """

    def __init__(self, columns: list[str], label: str, folds: int = 5, prior: float = 20.0):
        super().__init__()
        self.columns, self.label, self.folds, self.prior = columns, label, folds, prior

    def _fit(self, dataset: DataFrame) -> TargetStatisticsModel:
        y, fold = F.col(self.label).cast("double"), _fold(dataset, self.columns, self.label, self.folds)
        each = [F.struct(F.count(F.when(fold == k, y)).alias("n"), F.coalesce(F.sum(F.when(fold == k, y)), F.lit(0.0)).alias("s")) for k in range(self.folds)]
        tables = {c: dataset.groupBy(_category(c).alias("_key")).agg(F.count(y).alias("_n"), F.sum(y).alias("_s"), F.array(*each).alias("_folds")) for c in self.columns}
        return TargetStatisticsModel(self, tables, dataset.agg(F.avg(y)).first()[0])


class TargetStatisticsModel(Model):
    def __init__(self, made: TargetStatistics, tables: dict[str, DataFrame], mean: float | None):
        super().__init__()
        self.made, self.tables, self.mean = made, tables, mean or 0.0

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m = self.made
        known = m.label in dataset.columns and "split" in dataset.columns
        own = F.when(F.col("split") == "train", F.get("_folds", _fold(dataset, m.columns, m.label, m.folds))) if known else F.lit(None).cast("struct<n:long,s:double>")
        for c, table in self.tables.items():
            out = dataset.withColumn("_key", _category(c)).join(table, "_key", "left").withColumn("_own", own)
            n = F.coalesce("_n", F.lit(0)) - F.coalesce("_own.n", F.lit(0))
            total = F.coalesce("_s", F.lit(0.0)) - F.coalesce("_own.s", F.lit(0.0))
            dataset = out.withColumn(f"{c}_stat", (total + m.prior * self.mean) / (n + m.prior)).drop("_key", "_n", "_s", "_folds", "_own")
        return dataset


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _fold(rows: DataFrame, columns: list[str], label: str, folds: int) -> Column:
    """A row's fold, by a hash of its categories and label and the other plain columns' values."""
    plain = [c for c, t in rows.dtypes if t in ("string", "int", "bigint", "date", "timestamp", "double") and c != "split" and not c.endswith(("_idx", "_stat"))]
    return F.pmod(F.xxhash64(*plain, F.lit("fold")), F.lit(folds)).cast("int")


def wide_categories(rows: DataFrame, categorical: list[str], most: int = NATIVE) -> list[str]:
    """The columns with more categories than trees take natively."""
    if not categorical:
        return []
    n = rows.agg(*[F.count_distinct(_category(c)).alias(c) for c in categorical]).first()
    return [c for c in categorical if n[c] > most]


def design(categorical: list[str], numeric: list[str], one_hot: bool = True, out: str = "features", wide: list[str] | None = None, label: str | None = None) -> list:
    """Stages that encode and assemble: dummies, or indices that trees take as categories (F-12, M-10, M-18).

    Of the latter, ``wide`` columns become statistics of the label instead.
    """
    wide = wide or []
    narrow = [c for c in categorical if c not in wide]
    index = StringIndexer(inputCols=narrow, outputCols=[f"{c}_idx" for c in narrow], handleInvalid="keep") if narrow else None
    if not one_hot:
        statistics = TargetStatistics(wide, label) if wide else None
        assemble = VectorAssembler(inputCols=[f"{c}_idx" for c in narrow] + [f"{c}_stat" for c in wide] + numeric, outputCol=out, handleInvalid="keep")
        return [s for s in (index, statistics, assemble) if s]
    encode = OneHotEncoder(inputCols=[f"{c}_idx" for c in narrow], outputCols=[f"{c}_hot" for c in narrow]) if narrow else None
    return [s for s in (index, encode, VectorAssembler(inputCols=[f"{c}_hot" for c in narrow] + numeric, outputCol=out)) if s]


def quarter_dummies(rows: DataFrame, period: str) -> DataFrame:
    return rows.withColumns({f"q{k}": (F.quarter(period) == k).cast("double") for k in (1, 2, 3, 4)})


def split_by_hash(rows: DataFrame, key: str, train: float = 0.70, val: float = 0.15, salt: str = "split", candidates: Column | None = None) -> DataFrame:
    """Column split (train, val, test), from a hash, so that it is the same in every run; rows that are no candidates only train (M-09)."""
    u = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    s = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return rows.withColumn("split", s if candidates is None else F.when(candidates, s).otherwise("train"))


def split_by_period(rows: DataFrame, period: str, first_test) -> DataFrame:
    """Train before, test from (M-10, M-11)."""
    return rows.withColumn("split", F.when(F.col(period) < F.lit(first_test), "train").otherwise("test"))


def boosted(rows: DataFrame, label: str, categorical: list[str], numeric: list[str], one_hot: bool = True, iterations: int = 40, depth: int = 5, seed: int = SEED) -> PipelineModel:
    """Boosted trees fitted on the train rows (M-07, M-10, M-11, M-15)."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed, maxBins=64)
    train = rows.where("split = 'train'")
    wide = [] if one_hot else wide_categories(train, categorical)
    return Pipeline(stages=[*design(categorical, numeric, one_hot, wide=wide, label=label), gbt]).fit(train)


def encodings_compared(rows: DataFrame, label: str, categorical: list[str], numeric: list[str], iterations: int = 40) -> DataFrame:
    """Test errors of the same trees on dummies and on native categories with statistics (M-18): encoding, mae, rmse, r2, n."""
    out = None
    for name, one_hot in (("dummies", True), ("categories", False)):
        fitted = boosted(rows, label, categorical, numeric, one_hot, iterations)
        report = regression_report(fitted.transform(rows.where("split = 'test'")), label, "prediction").select(F.lit(name).alias("encoding"), "*")
        out = report if out is None else out.unionByName(report)
    return out


#: What a search draws its candidates from (M-08).
SEARCH_GRID = {"maxDepth": (3, 4, 5, 6), "maxIter": (20, 40, 80), "stepSize": (0.05, 0.1, 0.2), "subsamplingRate": (0.7, 0.85, 1.0), "minInstancesPerNode": (1, 5, 20)}


def drawn(candidates: int, grid: dict[str, tuple] | None = None, seed: int = SEED) -> list[dict]:
    """Different combinations of the grid's values, drawn at random; all of them, if there are no more than ``candidates``."""
    grid = SEARCH_GRID if grid is None else grid
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(every, min(candidates, len(every)))


def random_search(
    rows: DataFrame, label: str, categorical: list[str], numeric: list[str], candidates: int = 20, folds: int = 5, rounds: int = 3, rate: int = 3, side_by_side: int = 8, grid: dict[str, tuple] | None = None, seed: int = SEED
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated search over a random part of a grid, by mean absolute error (M-08).

    The train rows are encoded and written once; all fits read that table,
    ``side_by_side`` of them at a time, whatever their fold and candidate.  Each
    round fits the candidates left with a share of their trees (a ``rate``-th of
    the next round's) and keeps the better ``rate``-th of them, ties in drawing
    order; the last round has the whole number of trees.  ``rounds=1`` compares all
    candidates in full.  Rows without label or a number take no part, nor do
    categories of fewer than two values; equal rows are in one fold, and folds
    without rows count nothing: if all rows are in one, the first drawn stays.

    Returns the best candidate fitted on all train rows, and a row for each
    candidate and round: candidate, round, trees, mae, folds, kept, parameters.
    """
    names = tuple(SEARCH_GRID if grid is None else grid)
    train, _ = complete_cases(rows.where("split = 'train'"), [label, *numeric])
    train = train.withColumn("_fold", _fold(train, categorical, label, folds))
    if categorical:
        n = train.agg(*[F.count_distinct(c).alias(c) for c in categorical]).first()
        categorical = [c for c in categorical if n[c] > 1]
    encoder = Pipeline(stages=design(categorical, numeric)).fit(train)
    table = staged(encoder.transform(train).select("features", F.col(label).cast("double").alias("_y"), "_fold"))
    sizes = {r["_fold"]: r["n"] for r in table.groupBy("_fold").agg(F.count("*").alias("n")).collect()}  # a row for each fold
    if not sizes:
        raise ValueError("no complete train rows to search on")

    def trees(given: dict, trial_round: int) -> int:
        return max(1, math.ceil(given.get("maxIter", 20) / rate ** (rounds - 1 - trial_round)))

    def fitted(given: dict, n: int, part: DataFrame):
        return GBTRegressor(featuresCol="features", labelCol="_y", seed=seed, maxBins=64, **{**given, "maxIter": n}).fit(part)

    def error(job: tuple[dict, int, int]) -> float:
        given, n, fold = job
        held = fitted(given, n, table.where(F.col("_fold") != fold)).transform(table.where(F.col("_fold") == fold))
        return held.agg(F.avg(F.abs(F.col("_y") - F.col("prediction")))).first()[0]

    told, left = [], list(enumerate(drawn(candidates, grid, seed)))
    usable = sorted(sizes) if len(sizes) > 1 else []
    with ThreadPool(side_by_side) as pool:
        for k in range(rounds):
            jobs = [(given, trees(given, k), fold) for _, given in left for fold in usable]
            errors = pool.map(inheritable_thread_target(rows.sparkSession)(error), jobs, chunksize=1)
            each = len(usable)
            means = [sum(errors[i * each : (i + 1) * each]) / each if each else None for i in range(len(left))]
            order = sorted(range(len(left)), key=lambda i: (means[i] if each else 0.0, left[i][0]))
            keep = set(order[: 1 if k == rounds - 1 else max(1, math.ceil(len(left) / rate))])
            told += [(c, k, trees(given, k), means[i], each, i in keep, *[float(given[x]) for x in names]) for i, (c, given) in enumerate(left)]
            left = [x for i, x in enumerate(left) if i in keep]
    best = left[0][1]
    gbt = fitted(best, trees(best, rounds - 1), table)
    report = rows.sparkSession.createDataFrame(told, "candidate int, round int, trees int, mae double, folds int, kept boolean, " + ", ".join(f"{x} double" for x in names))
    return PipelineModel(stages=[*encoder.stages, gbt]), report


def importances(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """feature, importance of fitted trees (M-07); a category's dummies are features of their own."""
    meta = model.transform(rows).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for kind in meta.values() for a in kind}
    values = model.stages[-1].featureImportances.toArray()
    return rows.sparkSession.createDataFrame([(names.get(i, str(i)), float(v)) for i, v in enumerate(values)], "feature string, importance double")


def ablation(rows: DataFrame, label: str, levels: dict[int, tuple[str, ...]] | None = None, iterations: int = 20, categorical: list[str] | None = None, imputed: tuple[str, ...] = (), group: str = "dept") -> DataFrame:
    """Test errors of models on the features up to each level (M-17): level, features, mae, rmse, r2, n.

    All levels see the same rows: those with a label and all features of all
    levels.  ``imputed`` features lose no row: their gaps become the median of
    the ``group`` or of all, and from level 1 on each of them has a flag as a
    feature of its own.  ``features`` counts numbers and flags.
    """
    levels, categorical, out = FEATURE_LEVELS if levels is None else levels, categorical or [], None
    every = features_up_to(max(levels), levels)
    gaps = [c for c in every if c in imputed]
    rows, _ = complete_cases(rows, [label, *[c for c in every if c not in gaps]])
    if gaps:
        rows = group_fill(rows, gaps, group).withColumns({f"{c}_missing": F.col(f"{c}_missing").cast("double") for c in gaps})
        rows, _ = complete_cases(rows, gaps)  # a column of gaps alone
    rows = staged(rows)
    for level in sorted(levels):
        use = features_up_to(level, levels)
        use += [f"{c}_missing" for c in gaps if c in use and level >= 1]
        fitted = boosted(rows, label, categorical, use, iterations=iterations)
        report = regression_report(fitted.transform(rows.where("split = 'test'")), label, "prediction").select(F.lit(level).alias("level"), F.lit(len(use)).alias("features"), "*")
        out = report if out is None else out.unionByName(report)
    return out


def group_baseline(train: DataFrame, rows: DataFrame, label: str, group: str, tau: float = 0.5, out: str = "baseline") -> DataFrame:
    """Quantile of the group in the train rows, else of all (A-33)."""
    m = exact_quantile(train, [group], label, tau).select(group, F.col("quantile").alias("_g"))
    a = rows.sparkSession.range(1).select().join(exact_quantile(train, [], label, tau).select(F.col("quantile").alias("_a")), how="left")  # a row even without values
    return rows.join(m, group, "left").crossJoin(F.broadcast(a)).withColumn(out, F.coalesce("_g", "_a")).drop("_g", "_a")


def horizon_models(panel: DataFrame, horizons: tuple[int, ...], numeric: list[str], first_test, iterations: int = 20) -> dict[int, PipelineModel]:
    """One model for each horizon, split by the target's period (M-11)."""
    out = {}
    for h in horizons:
        rows = split_by_period(panel.where(F.col(f"target_{h}").isNotNull()), f"period_{h}", first_test)
        out[h] = boosted(rows, f"target_{h}", [], numeric, iterations=iterations)
    return out


def persistence(panel: DataFrame, horizons: tuple[int, ...], first_test, value: str = "price") -> DataFrame:
    """horizon, mae, n of the forecast that nothing changes, over the rows whose target is in the test periods (M-11)."""
    parts = [F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("y"), F.col(f"period_{h}").alias("at")) for h in horizons]
    rows = panel.select(F.col(value).alias("_v"), F.explode(F.array(*parts)).alias("t")).where(F.col("t.y").isNotNull() & F.col("_v").isNotNull() & (F.col("t.at") >= F.lit(first_test)))
    return rows.groupBy("t.horizon").agg(F.avg(F.abs(F.col("t.y") - F.col("_v"))).alias("mae"), F.count("*").alias("n"))


def horizon_report(models: dict[int, PipelineModel], panel: DataFrame, first_test, value: str = "price", coverage: float = 0.8) -> DataFrame:
    """horizon, mae, margin, n, baseline_mae and the better of both, on the test rows of each horizon (M-11).

    ``margin`` is the quantile of the absolute errors at the finite-sample
    level of ``coverage``: forecasts lie within it that often.
    """
    out = None
    for h, m in models.items():
        test = panel.where(F.col(f"target_{h}").isNotNull() & (F.col(f"period_{h}") >= F.lit(first_test)))
        e = m.transform(test).select(F.abs(F.col(f"target_{h}") - F.col("prediction")).alias("e"))
        n = e.count()
        level = min(1.0, math.ceil((n + 1) * coverage) / max(n, 1))
        margin = exact_quantile(e, [], "e", level).select(F.col("quantile").alias("margin"))
        n = e.agg(F.avg("e").alias("mae"), F.count("*").alias("n")).crossJoin(margin).select(F.lit(h).alias("horizon"), "mae", "margin", "n")
        out = n if out is None else out.unionByName(n)
    base = persistence(panel, tuple(models), first_test, value).select("horizon", F.col("mae").alias("baseline_mae"))
    return out.join(base, "horizon", "left").withColumn("better", verdict(F.col("mae"), F.col("baseline_mae")))


def calibrated_report(models: dict[int, PipelineModel], panel: DataFrame, first_test, first_report, coverage: float = 0.8) -> DataFrame:
    """horizon, margin_low, margin_high, n_calibrated, coverage, n (M-12).

    The margins are quantiles of the signed errors, at the finite-sample level,
    of rows whose target lies from ``first_test`` on and before ``first_report``;
    the coverage is that of later rows, which set no margin.
    """
    out, tail = None, (1 - coverage) / 2
    for h, m in models.items():
        rows = m.transform(panel.where(F.col(f"target_{h}").isNotNull() & (F.col(f"period_{h}") >= F.lit(first_test))))
        rows = rows.select((F.col(f"target_{h}") - F.col("prediction")).alias("e"), (F.col(f"period_{h}") < F.lit(first_report)).alias("sets"))
        sets = rows.where("sets")
        n = sets.count()
        low, high = max(0.0, math.floor((n + 1) * tail - 1) / max(n - 1, 1)), min(1.0, math.ceil((n + 1) * (1 - tail) - 1) / max(n - 1, 1))
        margins = exact_quantiles(sets, [], "e", [low, high]).select((-F.get("quantiles", F.lit(0))).alias("margin_low"), F.get("quantiles", F.lit(1)).alias("margin_high"), F.col("n").alias("n_calibrated"))
        met = rows.where(~F.col("sets")).crossJoin(F.broadcast(margins)).groupBy("margin_low", "margin_high", "n_calibrated")
        r = met.agg(F.avg(F.col("e").between(-F.col("margin_low"), F.col("margin_high")).cast("double")).alias("coverage"), F.count("*").alias("n")).select(F.lit(h).alias("horizon"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def forecast_ranges(models: dict[int, PipelineModel], latest: DataFrame, report: DataFrame, value: str = "price") -> DataFrame:
    """Forecasts with their interval and growth in percent, for each horizon of horizon_report or calibrated_report (M-12)."""
    sides = ("margin_low", "margin_high") if "margin_low" in report.columns else ("margin", "margin")
    margins = report.agg(*[F.max(F.when(F.col("horizon") == h, F.col(side))).alias(f"_{x}{h}") for h in models for x, side in zip("lh", sides, strict=True)])
    out = forecast(models, latest).crossJoin(F.broadcast(margins))
    for h in models:
        f = F.col(f"forecast_{h}")
        out = out.withColumns({f"low_{h}": f - F.col(f"_l{h}"), f"high_{h}": f + F.col(f"_h{h}"), f"growth_{h}": ratio(f - F.col(value), F.col(value), 100.0)})
    return out.drop(*[f"_{x}{h}" for h in models for x in "lh"])


def forecast(models: dict[int, PipelineModel], latest: DataFrame) -> DataFrame:
    """Forecasts of all horizons for the latest complete rows (M-12)."""
    out = latest
    for h, m in models.items():
        out = m.transform(out).withColumnRenamed("prediction", f"forecast_{h}").drop("features")
    return out


def forest_quantiles(train: DataFrame, rows: DataFrame, label: str, numeric: list[str], taus: list[float], key: str = "id", trees: int = 20, depth: int = 6, seed: int = SEED, points: int = 128) -> DataFrame:
    """Quantile regression forest (M-13): a row's quantiles over the train targets that share its leaves.

    A leaf is summed up by ``points`` of its quantiles, from a sketch that tasks
    merge, so a row meets ``trees`` times ``points`` values however many targets
    the leaves hold; a quantile is off by half a point's share at most.
    """
    pipe = Pipeline(stages=[VectorAssembler(inputCols=numeric, outputCol="features"), RandomForestRegressor(labelCol="_y", numTrees=trees, maxDepth=depth, leafCol="leaves", seed=seed)]).fit(train.withColumn("_y", F.log1p(label)))
    leaf = lambda df, *c: pipe.transform(df).select(*c, F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    middles = F.array(*[F.lit((k + 0.5) / points) for k in range(points)])
    summed = leaf(train.withColumn("_y", F.log1p(label)), F.col("_y").alias("y")).groupBy("tree", "leaf").agg(F.percentile_approx("y", middles, 20 * points).alias("_q"))
    met = leaf(rows.withColumn("_y", F.lit(0.0)), key).join(summed, ["tree", "leaf"]).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("_q"))).alias("_v"))
    at = lambda tau: F.greatest(F.ceil(F.size("_v") * F.lit(tau) - 1e-9), F.lit(1)).cast("int")
    q = met.select(key, *[F.expm1(F.element_at("_v", at(tau))).alias(f"q{int(round(tau * 100)):02d}") for tau in taus])
    return rows.join(q, key)


def conformal_margin(rows: DataFrame, low: str, high: str, label: str, alpha: float = 0.2) -> DataFrame:
    """margin, level, n: the quantile of the scores at the finite-sample level widens the interval to its coverage (M-14); no row without scores."""
    score = F.greatest(F.col(low) - F.col(label), F.col(label) - F.col(high))
    n = rows.where(F.col(label).isNotNull()).count()
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / max(n, 1))
    margin = exact_quantile(rows.select(score.alias("s")), [], "s", level)
    return margin.select(F.col("quantile").alias("margin"), F.lit(level).alias("level"), "n")


def interval_coverage(rows: DataFrame, low: str, high: str, label: str, margin: Column | None = None) -> DataFrame:
    m = F.lit(0.0) if margin is None else margin
    return rows.agg(F.avg(F.col(label).between(F.col(low) - m, F.col(high) + m).cast("double")).alias("coverage"))


def regression_report(rows: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """mae, rmse, r2 (null without variance) in one aggregation (M-16)."""
    e = F.col(label) - F.col(predicted)
    total = F.var_pop(label) * F.count(label)
    return rows.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(*(by or [])).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(total > 0, 1 - F.sum(e * e) / total).alias("r2"), F.count("*").alias("n"))


def pinball(label: Column, predicted: Column, tau: float) -> Column:
    """Aggregate: mean quantile loss."""
    e = label - predicted
    return F.avg(F.greatest(tau * e, (tau - 1) * e))


def verdict(model_mae: Column, baseline_mae: Column) -> Column:
    return F.when(model_mae < baseline_mae, "model").otherwise("baseline")


def handed_off(base: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Model outputs side by side for each place (J-21, J-12)."""
    for p in parts:
        base = base.join(p, key, "left")
    return base


def bounded_sample(rows: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """Exactly n rows (all, if fewer), the same in every run and at any partitioning (T-07)."""
    return hashed_first(rows, [key], n, salt)
