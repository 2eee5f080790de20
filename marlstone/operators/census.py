"""Census tables: sums, shares, breakdowns and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import canonical_code, fold_code, ratio
from marlstone.operators.ranks import exact_quantile
from marlstone.operators.rejects import quarantined


def folded_sums(cells: DataFrame, by: list[str], columns: list[str], positive: str | None = None) -> DataFrame:
    """Sums over cells (A-13, A-16, A-19, A-21); places where ``positive`` isn't above 0 are dropped."""
    out = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])
    return out.where(F.col(positive) > 0) if positive else out


def ratios(cells: DataFrame, by: list[str], pairs: dict[str, tuple[str, str]], base: str | None = None) -> DataFrame:
    """Named ratios of sums, null where the denominator isn't positive (A-13..A-15, A-18)."""
    parts = sorted({c for p in pairs.values() for c in p} | ({base} if base else set()))
    sums = folded_sums(cells, by, parts, base)
    return sums.select(*by, *[ratio(F.col(n), F.col(d)).alias(k) for k, (n, d) in pairs.items()])


def shares(rows: DataFrame, by: list[str], kind: str, kinds: list[str], amount: str) -> DataFrame:
    """A column for each kind with its share of the place's total (A-17, A-18, A-31)."""
    wide = rows.groupBy(*by).pivot(kind, kinds).agg(F.sum(amount)).na.fill(0.0, kinds)
    total = sum((F.col(k) for k in kinds), F.lit(0.0))
    return wide.select(*by, total.alias("total"), *[ratio(F.col(k), total).alias(k) for k in kinds])


def percent_map(columns: list[str]) -> Column:
    """Map of percentages, one digit, half to even; null if all are 0 (A-29, A-30)."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    entries = F.create_map(*[x for c in columns for x in (F.lit(c), F.bround(F.coalesce(c, F.lit(0.0)) * 100.0 / total, 1))])
    return F.when(total > 0, entries)


def breakdown(rows: DataFrame, key: str, kind: str, amount: str, known: list[str]) -> DataFrame:
    """Map of amounts per kind; unknown kinds are ``other``, zero entries are left out (A-26)."""
    k = F.when(F.col(kind).isin(known), F.col(kind)).otherwise("other").alias("kind")
    g = rows.groupBy(key, k).agg(F.sum(amount).alias("n")).where("n != 0")
    return g.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("breakdown"))


def pyramid(rows: DataFrame, key: str, sex: str, band: str, amount: str) -> DataFrame:
    """Nested counts: sex to age band to number (A-28)."""
    g = rows.groupBy(key, sex, band).agg(F.sum(amount).alias("n")).groupBy(key, sex).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(band, "n")))).alias("bands"))
    by_sex = F.array_sort(F.collect_list(F.struct(F.col(sex).alias("s"), "bands")), lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0))
    return g.groupBy(key).agg(F.map_from_entries(by_sex).alias("pyramid"))


def grouped_median(counts: Column, lower: list[float], width: list[float]) -> Column:
    """Median of bucketed values, interpolated within its bucket (A-27); null for an empty total."""
    half = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / 2
    buckets = F.arrays_zip(counts.alias("f"), F.array(*[F.lit(float(x)) for x in lower]).alias("low"), F.array(*[F.lit(float(x)) for x in width]).alias("width"))
    found = F.aggregate(
        buckets,
        F.struct(F.lit(0.0).alias("cf"), F.lit(None).cast("double").alias("m")),
        lambda a, b: F.struct((a["cf"] + b["f"]).alias("cf"), F.coalesce(a["m"], F.when((b["f"] > 0) & (half <= a["cf"] + b["f"]), b["low"] + (half - a["cf"]) / b["f"] * b["width"])).alias("m")),
    )
    return F.when(half > 0, found["m"])


def latest_year_sums(rows: DataFrame, code: str, folded: str, year: str, amount: str) -> DataFrame:
    """Latest year of each code, then sums by folded code (A-25)."""
    last = rows.withColumn("_y", F.max(year).over(Window.partitionBy(code))).where(F.col(year) == F.col("_y"))
    return last.groupBy(folded).agg(F.sum(amount).alias(amount))


def text_sets(rows: DataFrame, key: str, text: str, day: str) -> DataFrame:
    """Sorted distinct texts joined by " + ", and the latest day (A-43)."""
    return rows.groupBy(key).agg(F.concat_ws(" + ", F.array_sort(F.collect_set(text))).alias("details"), F.max(day).alias("as_of"))


def collapsed(rows: DataFrame, key: str, note: str, order: str, day: str) -> DataFrame:
    """First note and latest day (A-44)."""
    return rows.groupBy(key).agg(F.min_by(note, order).alias("note"), F.max(day).alias("as_of"))


def zones(records: DataFrame) -> DataFrame:
    """Distinct regions and departments of commune records, with the parent's code (A-42)."""
    regions = records.select(F.lit("region").alias("level"), F.col("region.code").alias("code"), F.col("region.nom").alias("name"), F.lit("FR").alias("parent"))
    depts = records.select(F.lit("department").alias("level"), F.col("departement.code").alias("code"), F.col("departement.nom").alias("name"), F.col("region.code").alias("parent"))
    return regions.unionByName(depts).distinct()


def group_profile(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Mean, median and count of each feature per group, long form (A-36)."""
    long = rows.unpivot([group], features, "feature", "value")
    middle = exact_quantile(long, [group, "feature"], "value").select(group, "feature", F.col("quantile").alias("median"))
    return long.groupBy(group, "feature").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).join(middle, [group, "feature"], "left").select(group, "feature", "mean", "median", "n")


def standardised_profile(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Group means as z-scores against all rows, sample deviation (A-37)."""
    stats = rows.agg(*[x for f in features for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_s_{f}"))])
    means = rows.groupBy(group).agg(*[F.avg(f).alias(f) for f in features])
    return means.crossJoin(F.broadcast(stats)).select(group, *[((F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).alias(f) for f in features])


def bin_shares(rows: DataFrame, value: str, volume: str, edges: list[float]) -> DataFrame:
    """Share of places and of volume per left-closed bin (A-35)."""
    b = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        b = F.when((F.col(value) >= edges[k]) & (F.col(value) < edges[k + 1]), k).otherwise(b)
    g = rows.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.sum(volume).alias("v"))
    w = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each bin
    return g.select("bin", (F.col("n") / F.sum("n").over(w)).alias("share_places"), (F.col("v") / F.sum("v").over(w)).alias("share_volume"))


def yearly_values(files: list[DataFrame], keys: list[str], value: str, line: str, first_wins: bool = True) -> DataFrame:
    """One value for each of ``keys``, such as code and year: the last line of the file that wins (A-20, S-24).

    That is the first file that has the key, or with ``first_wins`` off the last.
    """
    rows = None
    for k, f in enumerate(files):
        f = f.select(*keys, value, F.struct(F.lit(-k if first_wins else k).alias("file"), F.col(line).alias("line")).alias("_at"))
        rows = f if rows is None else rows.unionByName(f)
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, "_at").alias(value))


def named_means(rows: DataFrame, by: str, kind: str, value: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Means under each of the names of a row's kind, such as one rent file for two sizes (A-22)."""
    of = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return rows.select(by, value, F.explode(of[F.col(kind)]).alias("name")).groupBy(by, "name").agg(F.avg(value).alias(value))


def truncated_sums(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Sums of whole parts (A-24)."""
    return rows.groupBy(by).agg(F.sum(F.col(value).cast("long")).alias(value))


def active_population(cells: DataFrame, code: str, value: str) -> DataFrame:
    """city, value: sums of a text column over cells whose codes fold together; what is no number counts 0, places at 0 or below go (A-16)."""
    v = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))
    return folded_sums(cells.select(fold_code(canonical_code(F.col(code))).alias("city"), v.alias("value")), ["city"], ["value"], "value")


def yearly_counts(rows: DataFrame, most: float, code: str = "GEO", year: str = "TIME_PERIOD", value: str = "OBS_VALUE") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Counts of a long text file by place and year (A-21), its rejected rows with their reason, and how many there are (S-06).

    Empty values are skipped, those that are no number or year or lie outside
    of 0 to ``most`` are rejected, then codes fold together and are summed.
    """
    v, y = F.col(value).try_cast("double"), F.col(year).try_cast("int")
    good, bad, n = quarantined(rows.where(F.trim(value) != ""), {"no number": v.isNotNull() & y.isNotNull() & F.col(code).isNotNull(), "out of band": v.between(0, most)})
    by = good.select(fold_code(canonical_code(F.col(code))).alias("city"), y.alias("year"), v.alias("value"))
    return folded_sums(by, ["city", "year"], ["value"]), bad, n


def rounded_sums(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Sums rounded to whole numbers, halves to even (A-24)."""
    return rows.groupBy(by).agg(F.bround(F.sum(F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))), 0).cast("long").alias(value))
