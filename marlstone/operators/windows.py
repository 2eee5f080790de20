"""Sequences of observations: latest values, growth, lags, snapshots and pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ranks import exact_quantile, exact_quantiles, medians

TREND, OUTLIER = 0.02, 3.0


def keep_latest(points: DataFrame, keys: list[str], written: str = "written_at", tie: str | None = None) -> DataFrame:
    """The most recently written row of each key (W-10, W-12, W-13)."""
    order = [F.col(written).desc_nulls_last()] + ([F.col(tie)] if tie else [])
    return points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key by a given order: priced first, then oldest, or the most populous (J-04, W-12)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_wide(points: DataFrame, names: list[str], geo: str = "geo", serie: str = "serie", period: str = "period", value: str = "value") -> DataFrame:
    """Latest value of each serie, a column each (W-01): one aggregation, no window."""
    return points.groupBy(geo).pivot(serie, names).agg(F.max_by(value, period))


def latest(points: DataFrame, geo: str = "geo") -> DataFrame:
    """Latest value of one serie per place."""
    return points.groupBy(geo).agg(F.max_by("value", "period").alias("value"), F.max("period").alias("period"))


def from_last(points: DataFrame, geo: str = "geo") -> DataFrame:
    """Points numbered from the last, 1, back."""
    return points.withColumn("back", F.row_number().over(Window.partitionBy(geo).orderBy(F.col("period").desc())))


def mean_of_last(points: DataFrame, n: int = 4) -> DataFrame:
    """W-02."""
    return from_last(points).where(F.col("back") <= n).groupBy("geo").agg(F.avg("value").alias("value"))


def sum_of_last(points: DataFrame, n: int = 4) -> DataFrame:
    """W-03."""
    return from_last(points).where(F.col("back") <= n).groupBy("geo").agg(F.sum("value").cast("long").alias("value"))


def snapshot(prices: DataFrame, volumes: DataFrame, medians: DataFrame | None = None, outlier: float = OUTLIER) -> DataFrame:
    """Fields of a place from its price and volume series (W-02..W-06, G-08, J-10).

    Growth and trend go by position among the observed quarters.  Prices of
    places far above their department's median are withheld, volumes stay.
    """
    back = from_last(prices)
    at = lambda n: F.max(F.when(F.col("back") == n, F.col("value")))
    line = F.array_sort(F.collect_list(F.when(F.col("back") <= 8, F.struct("period", F.bround("value", 0).alias("v")))))
    g = back.where(F.col("back") <= 13).groupBy("geo").agg(at(1).alias("last"), at(2).alias("before"), at(13).alias("base"), F.avg(F.when(F.col("back") <= 4, F.col("value"))).alias("avg4"), line.alias("line"))
    if medians is not None:
        g = g.join(medians, "geo", "left").where(F.col("median").isNull() | (F.col("last") <= outlier * F.col("median")))
    step = F.when(F.col("before") != 0, (F.col("last") - F.col("before")) / F.col("before")).otherwise(0.0)
    price = g.select(
        "geo", F.bround("last", 2).alias("median_price_per_sqm"), F.bround("avg4", 2).alias("avg_price_per_sqm"),
        F.bround(F.when(F.col("base") > 0, (F.col("last") / F.col("base") - 1) * 100), 2).alias("price_growth_3y"),
        F.when(F.col("before").isNull(), "stable").when(step > TREND, "up").when(step < -TREND, "down").otherwise("stable").alias("price_trend"),
        F.to_json(F.transform("line", lambda p: p["v"])).alias("sparkline"),
    )
    return price.join(sum_of_last(volumes).withColumnRenamed("value", "transaction_volume"), "geo", "full")


def growth_over_years(points: DataFrame, years: int = 5) -> DataFrame:
    """Percent against exactly so many calendar years before the latest (W-07); none if that year is absent.

    One pass: the latest year by window, then a conditional maximum.
    """
    y = points.withColumn("last", F.max("year").over(Window.partitionBy("geo")))
    g = y.groupBy("geo").agg(F.max(F.when(F.col("year") == F.col("last"), F.col("value"))).alias("now"), F.max(F.when(F.col("year") == F.col("last") - years, F.col("value"))).alias("then"))
    return g.where(F.col("then") > 0).select("geo", ((F.col("now") / F.col("then") - 1) * 100).alias("growth"))


def with_lags(panel: DataFrame, lags: tuple[int, ...] = (1, 2, 4), value: str = "price") -> DataFrame:
    """W-08: lags by observed position."""
    w = Window.partitionBy("geo").orderBy("period")
    return panel.withColumns({f"{value}_lag{n}": F.lag(value, n).over(w) for n in lags})


def with_targets(panel: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 4), value: str = "price") -> DataFrame:
    """W-09: later values and their periods."""
    w = Window.partitionBy("geo").orderBy("period")
    return panel.withColumns({f"target_{h}": F.lead(value, h).over(w) for h in horizons} | {f"period_{h}": F.lead("period", h).over(w) for h in horizons})


def jumps(points: DataFrame, threshold: float, floor: float = 0.0, top: int | None = 40) -> DataFrame:
    """Relative steps beyond a threshold from a base of at least ``floor``, the largest first (W-14, T-05, K-03)."""
    w = Window.partitionBy("serie", "geo").orderBy("period")
    c = points.withColumn("prev", F.lag("value").over(w)).where((F.col("prev") >= floor) & (F.col("prev") != 0)).withColumn("change", (F.col("value") - F.col("prev")) / F.col("prev")).where(F.abs("change") > threshold)
    return c.orderBy(F.abs("change").desc(), "serie", "geo", "period").limit(top) if top else c


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Lowest value at which the running weight reaches half of all (W-17)."""
    return exact_quantiles(rows, keys, value, [0.5], weight).select(*keys, F.get("quantiles", F.lit(0)).alias("weighted_median"))


def pooled_until(pairs: DataFrame, enough: int, target: str = "target", most: int = 60) -> DataFrame:
    """Neighbours, nearest first and ``most`` at most, until their counts n reach ``enough``; the one that crosses it is taken (W-16)."""
    near = Window.partitionBy(target).orderBy("km", "point")
    cum = F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumns({"cum": cum, "_nth": F.row_number().over(near)}).where((F.col("cum") - F.col("n") < enough) & (F.col("_nth") <= most)).drop("_nth")


def time_adjusted(sales: DataFrame) -> DataFrame:
    """Prices at the department's level of the last year (G-05): column adj."""
    med = exact_quantile(sales, ["dept", "year"], "price_sqm").withColumnRenamed("quantile", "m")
    last = sales.agg(F.max("year").alias("last"))
    ref = med.crossJoin(F.broadcast(last)).where(F.col("year") == F.col("last")).select("dept", F.col("m").alias("ref"))
    factor = med.join(ref, "dept", "left").select("dept", "year", (F.col("ref") / F.col("m")).alias("factor"))
    return sales.join(factor, ["dept", "year"], "left").withColumn("adj", F.col("price_sqm") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def pooled_targets(sales: DataFrame, cities: DataFrame, pairs: DataFrame, excluded: DataFrame | None = None, own: int = 30, thin: int = 10, scale_km: float = 10.0) -> DataFrame:
    """Price target of each city, own or pooled from neighbours (G-06).

    ``pairs`` are near cities of a department (target, point, km), a city with
    itself among them; those without sales lend none and do not count; ``excluded`` cities lend no sales.  Columns: city, n_own, n_pooled,
    radius_km, target, reliability (own, pooled, own_thin or null).
    """
    mine = sales.groupBy("city").agg(F.count("*").alias("n_own"), F.percentile("adj", F.lit(0.5)).alias("price_own"))
    lend = sales if excluded is None else sales.join(excluded, "city", "left_anti")
    counts = lend.groupBy(F.col("city").alias("point")).agg(F.count("*").alias("n"))
    needy = cities.select("city").join(mine, "city", "left").where(F.coalesce("n_own", F.lit(0)) < own).select(F.col("city").alias("target"))
    if excluded is not None:
        needy = needy.join(excluded.withColumnRenamed("city", "target"), "target", "left_anti")
    taken = pooled_until(pairs.join(needy, "target").join(counts, "point"), own)
    reach = taken.groupBy("target").agg(F.sum("n").alias("n_pooled"), F.max("km").alias("radius_km"))
    weighted = taken.join(lend.select(F.col("city").alias("point"), "adj"), "point").withColumn("w", 1 / (1 + F.col("km") / scale_km))
    med = weighted_median(weighted, ["target"], "adj", "w").withColumnRenamed("weighted_median", "pooled")
    out = cities.select("city").join(mine, "city", "left").join(reach.join(med, "target", "left").withColumnRenamed("target", "city"), "city", "left")
    n = F.coalesce("n_own", F.lit(0))
    kind = F.when(n >= own, "own").when(F.col("n_pooled") >= own, "pooled").when(F.col("n_pooled").isNotNull() & (n >= thin), "own_thin")
    out = out.withColumn("reliability", kind)
    target = F.when(F.col("reliability").isin("own", "own_thin"), F.col("price_own")).when(F.col("reliability") == "pooled", F.col("pooled"))
    return out.select("city", n.alias("n_own"), F.coalesce("n_pooled", n).alias("n_pooled"), F.coalesce("radius_km", F.lit(0.0)).alias("radius_km"), target.alias("target"), "reliability")


def group_fill(rows: DataFrame, columns: list[str], group: str = "dept") -> DataFrame:
    """Missing values by the group's median, else the median of all, with a flag each (G-07, A-33)."""
    one = rows.sparkSession.range(1).select()
    m, a = medians(rows, [group], columns, "_g_"), one.join(medians(rows, [], columns, "_a_"), how="left")  # a row even without values
    out = rows.join(m, group, "left").crossJoin(F.broadcast(a))
    out = out.withColumns({f"{c}_missing": F.col(c).isNull() for c in columns}).withColumns({c: F.coalesce(c, f"_g_{c}", f"_a_{c}") for c in columns})
    return out.drop(*[f"_{k}_{c}" for k in "ga" for c in columns])
