"""Exact quantiles of groups of any size, several at once, with or without weights.

``F.percentile`` holds all distinct values of a group in one task.  Here large
groups are cut into bins at the values of a quantile sketch; the bins' weights
tell which bins hold the wanted ranks, and only their rows are ranked.  Bins
cover all values, so a coarse sketch costs time, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.staging import staged

#: Rows up to which a group is ranked whole.
ACCURACY = 10_000
#: Binary digits of the number of bins of a large group.
DIGITS = 8


def _bin(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts lie below a value, by halving."""
    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(DIGITS))]), F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, qs: list[float], weight: str | None = None, upper: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """Keys, n and ``quantiles``, an array in the order of ``qs``; rows with a null key, value or weight are left out.

    Quantiles are interpolated between two values, or with ``upper`` the value
    at position floor(n * q) from 0; with ``weight`` the lowest value at which
    the running weight reaches that share of all (W-17).
    """
    held = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for k in [*keys, *([weight] if weight else [])]:
        held &= F.col(k).isNotNull()
    by = keys or ["_all"]
    own = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    rows = staged(rows.where(held).select(*own, F.col(value).alias("_v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")))  # read four times
    if weight or upper:
        return _in_bins(rows, by, qs, bool(weight), upper, accuracy).select(*keys, "n", "quantiles")
    large = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > accuracy).select(*by)
    some = not large.isEmpty()
    whole = (rows.join(large, by, "left_anti") if some else rows).groupBy(*by).agg(F.count("*").alias("n"), F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs])).alias("quantiles"))
    out = whole.unionByName(_in_bins(rows.join(large, by, "left_semi"), by, qs, False, False, accuracy)) if some else whole
    return (out if keys else out.where("n > 0")).select(*keys, "n", "quantiles")


def _in_bins(rows: DataFrame, by: list[str], qs: list[float], weight: bool, upper: bool, accuracy: int) -> DataFrame:
    """``by``, n, quantiles of (by, _v, _w)."""
    n, total = F.col("n"), F.col("_total")
    places: list[Column] = []  # a value's running weight reaches each of these
    for q in qs:
        if weight:
            places.append(F.greatest(total * q, F.lit(1e-300)))
        elif upper:
            places.append(F.least(F.floor(n * q), n - 1) + 0.5)
        else:
            places += [F.floor((n - 1) * F.lit(float(q))) + 0.5, F.ceil((n - 1) * F.lit(float(q))) + 0.5]
    cuts = F.percentile_approx("_v", F.array(*[F.lit(k / (1 << DIGITS)) for k in range(1, 1 << DIGITS)]), accuracy)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_w").alias("_total"), F.when(F.count("*") > accuracy, cuts).alias("_cuts"))
    wanted = sizes.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("i"), p.cast("double").alias("at")) for k, p in enumerate(places)])).alias("_p")).select(*by, "n", "_p.*")
    small = wanted.where(n <= accuracy).select(*by, F.lit(0).alias("_bin"), "i", "at", F.lit(0.0).alias("_before"))

    binned = rows.join(sizes.select(*by, "n", "_cuts"), by).withColumn("_bin", F.when(F.col("_cuts").isNull(), 0).otherwise(_bin(F.col("_cuts"), F.col("_v")))).drop("_cuts")
    over = Window.partitionBy(*by).orderBy("_bin")  # a row for each bin
    sums = binned.where(n > accuracy).groupBy(*by, "_bin").agg(F.sum("_w").alias("_s")).withColumns({"_to": F.sum("_s").over(over), "_last": F.max("_bin").over(Window.partitionBy(*by))})
    reached = (F.col("_to") >= F.col("at")) & (F.col("_to") - F.col("_s") < F.col("at")) | (F.col("_bin") == F.col("_last")) & (F.col("_to") < F.col("at"))
    large = sums.join(wanted.where(n > accuracy), by).where(reached).select(*by, "_bin", "i", "at", (F.col("_to") - F.col("_s")).alias("_before"))
    chosen = small.unionByName(large)

    inside = binned.where(n <= accuracy).drop("n").unionByName(binned.where(n > accuracy).drop("n").join(large.select(*by, "_bin").distinct(), [*by, "_bin"]).select(*by, "_v", "_w", "_bin"))
    counted = inside.groupBy(*by, "_bin", "_v").agg(F.sum("_w").alias("_s")).withColumn("_to", F.sum("_s").over(Window.partitionBy(*by, "_bin").orderBy("_v")))
    found = counted.join(chosen, [*by, "_bin"]).groupBy(*by, "i").agg(F.coalesce(F.min(F.when(F.col("_before") + F.col("_to") >= F.col("at"), F.col("_v"))), F.max("_v")).alias("_v"))
    values = found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_v"))), lambda x: x["_v"]).alias("_q"))  # a few for each group
    out = values.join(sizes.select(*by, "n"), by)
    if not weight and not upper:
        part = lambda q: (n - 1) * F.lit(float(q)) - F.floor((n - 1) * F.lit(float(q)))
        pairs = [(F.get("_q", F.lit(2 * k)), F.get("_q", F.lit(2 * k + 1)), part(q)) for k, q in enumerate(qs)]
        out = out.withColumn("_q", F.array(*[F.when(low == high, low).otherwise(low * (1 - p) + high * p) for low, high, p in pairs]))  # as F.percentile
    return out.select(*by, "n", F.col("_q").alias("quantiles"))


def exact_quantile(rows: DataFrame, keys: list[str], value: str, q: float = 0.5, upper: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """Keys, n and the quantile of each group as column ``quantile``; see ``exact_quantiles``."""
    return exact_quantiles(rows, keys, value, [q], upper=upper, accuracy=accuracy).withColumn("quantile", F.get("quantiles", F.lit(0))).drop("quantiles")


def medians(rows: DataFrame, keys: list[str], columns: list[str], prefix: str = "") -> DataFrame:
    """Keys and the median of each column, as columns of the same names after ``prefix``; groups without any value are left out."""
    long = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "_feature", "_value")
    q = exact_quantile(long, [*keys, "_feature"], "_value")
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("_feature") == c, F.col("quantile"))).alias(f"{prefix}{c}") for c in columns])
