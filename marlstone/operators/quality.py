"""Audits: coverage, fill rates, anomalies, duplicates and differences between datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ranks import exact_quantile


def overview(points: DataFrame) -> DataFrame:
    """Per serie: places, periods, least, upper median and largest value (K-01).

    The upper median is the value at half the count in order, ranked within a
    bracket, so no serie is sorted in one task.
    """
    points = points.where(F.col("value").isNotNull())
    mid = exact_quantile(points, ["serie"], "value", upper=True).select("serie", F.col("quantile").alias("upper_median"))
    ends = points.groupBy("serie").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    n = lambda c, name: points.select("serie", c).distinct().groupBy("serie").agg(F.count(c).alias(name))
    return n("geo", "places").join(n("period", "periods"), "serie").join(ends, "serie").join(mid, "serie").select("serie", "places", "periods", "low", "upper_median", "high")


def year_over_year(points: DataFrame, n: int = 4) -> DataFrame:
    """Percent of the mean of the last n national values against the n before (W-15)."""
    nat = points.groupBy("serie", "period").agg(F.avg("value").alias("v"))
    b = nat.withColumn("back", F.row_number().over(Window.partitionBy("serie").orderBy(F.col("period").desc())))
    last, prev = F.avg(F.when(F.col("back") <= n, F.col("v"))), F.avg(F.when(F.col("back").between(n + 1, 2 * n), F.col("v")))
    return b.where(F.col("back") <= 2 * n).groupBy("serie").agg(((last - prev) / prev * 100).alias("yoy"), F.count("*").alias("k")).where(F.col("k") == 2 * n).drop("k")


def coverage(points: DataFrame, expected: Column) -> DataFrame:
    """Share of expected places with a value per serie and period, with a band (K-02)."""
    g = points.where(F.col("value").isNotNull()).groupBy("serie", "period").agg((F.count_distinct("geo") * 100.0 / expected).alias("percent"))
    return g.withColumn("band", F.when(F.col("percent") >= 85, "good").when(F.col("percent") >= 50, "partial").otherwise("poor"))


def ordering(points: DataFrame, names: list[str], descending: bool) -> DataFrame:
    """Means of series that should be ordered, with a flag where one breaks the order (K-04)."""
    pos = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])
    m = points.where(F.col("serie").isin(names)).groupBy("serie").agg(F.avg("value").alias("mean")).withColumn("pos", pos[F.col("serie")])
    nxt = F.lead("mean").over(Window.orderBy("pos"))  # a row for each name
    broken = nxt > F.col("mean") if descending else nxt < F.col("mean")
    return m.withColumn("violates", F.coalesce(broken, F.lit(False))).drop("pos")


def fill_rates(rows: DataFrame, columns: list[str], no_source: tuple[str, ...] = ()) -> DataFrame:
    """Filled rows of each column, from one aggregation, with a status (K-05)."""
    counts = rows.agg(F.count("*").alias("_all"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot(["_all"], columns, "column", "filled")
    status = F.when(F.col("column").isin(*no_source), "NO-SOURCE").when(F.col("filled") == 0, "EMPTY").when(F.col("filled") == F.col("_all"), "OK").otherwise("PARTIAL")
    return long.select("column", "filled", F.col("_all").alias("total"), status.alias("status"))


def counts_per_name(points: DataFrame, names: DataFrame, levels: list[str]) -> DataFrame:
    """Series of each declared name per level, names without any included (K-06)."""
    s = points.select("serie", "geo_level", "geo").distinct()
    g = s.groupBy("serie").agg(*[F.count_if(F.col("geo_level") == lv).alias(lv) for lv in levels])
    return names.join(g, "serie", "left").na.fill(0, levels)


def completeness(target: DataFrame, reference: DataFrame, share: float = 0.98) -> DataFrame:
    """Probes (name, n) of which the target has less than the share of the reference (K-07, K-08)."""
    t, r = target.select("name", F.col("n").alias("have")), reference.select("name", F.col("n").alias("want"))
    return r.join(t, "name", "left").na.fill(0, ["have"]).where(F.col("have") < share * F.col("want"))


def with_followers(missing: DataFrame, follows: DataFrame) -> DataFrame:
    """name, distance: missing steps and all that follow from them, each with the fewest steps to a missing one (K-07).

    ``follows`` has a row (name, follower) for each dependency; a recursive
    query goes along it, at most once for each step, so circles end.
    """
    spark, tag = missing.sparkSession, uuid.uuid4().hex
    missing.select("name").distinct().createOrReplaceTempView(f"missing_{tag}")
    follows.select("name", "follower").distinct().createOrReplaceTempView(f"follows_{tag}")
    longest = follows.select("name").distinct().count()  # a chain without a circle has no more links
    return spark.sql(f"""
        WITH RECURSIVE reached(name, distance) AS (
            SELECT name, 0 FROM missing_{tag} UNION ALL
            SELECT f.follower, r.distance + 1 FROM reached r JOIN follows_{tag} f ON f.name = r.name WHERE r.distance < {longest}
        ) SELECT name, min(distance) AS distance FROM reached GROUP BY name""")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (K-09)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def top_counts(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """T-06: a report."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def weighted_report(rows: DataFrame, value: str, weight: str, below: float) -> DataFrame:
    """Mean, weighted mean, share below a threshold and correlation of value and weight (A-34)."""
    return rows.agg(F.avg(value).alias("mean"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"), F.avg((F.col(value) < below).cast("double")).alias("share_below"), F.corr(value, weight).alias("correlation"))


def groups_by_mean(rows: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    """Groups of at least so many values with their mean and rank, the highest first (A-34)."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), group)))  # a row for each department


def provenance(rows: DataFrame, value: str, source: str) -> DataFrame:
    """Rows by where their value comes from; ``none`` without a value (A-40)."""
    return rows.groupBy(F.when(F.col(value).isNull(), "none").otherwise(F.coalesce(source, F.lit("dvf"))).alias("source")).agg(F.count("*").alias("n"))
