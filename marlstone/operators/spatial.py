"""Nearest points, containment and inverse-distance weighting.

Joins are blocked by grid cells, so that only near candidates meet: a point
stands in one cell, and asks in the cells around it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import flat_distance2, haversine_km
from marlstone.functions.space import DEGREE_KM


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def near_pairs(targets: DataFrame, points: DataFrame, max_km: float, target_id: str = "id", point_id: str = "id", same: bool = False, block: str | None = None) -> DataFrame:
    """target, point, km of all pairs up to ``max_km``; both have lat and lon.

    Cells are ``max_km`` high; a target asks in the rows above and below and
    in as many columns as the distance spans at its latitude.  Columns go
    round the earth, the last beside the first, so no pair is missed, and each
    is met once.  ``block`` restricts pairs to an equal column.
    """
    size = max_km / DEGREE_KM
    columns = max(1, math.floor(360 / size))

    def column(lon: Column) -> Column:
        return F.floor((lon + 180) * (columns / 360)).cast("long")

    span = F.ceil(F.lit(1.0) / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("lat")) + size, F.lit(89.9)))), F.lit(1e-3)))
    b = [F.col(block).alias("block")] if block else [F.lit(0).alias("block")]
    ask = targets.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col(target_id).alias("target"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), *b,
        F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: _cell(F.col("lat"), size) + k)).alias("cy"), F.least(span, F.lit(columns)).cast("long").alias("_n"), column(F.col("lon")).alias("_x"),
    )
    around = F.array_distinct(F.transform(F.sequence(F.col("_x") - F.col("_n"), F.col("_x") + F.col("_n")), lambda c: F.pmod(c, F.lit(columns))))
    ask = ask.select("target", "tlat", "tlon", "block", "cy", F.explode(around).alias("cx"))
    stand = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(point_id).alias("point"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), *b, _cell(F.col("lat"), size).alias("cy"), F.pmod(column(F.col("lon")), F.lit(columns)).alias("cx"))
    pairs = ask.join(stand, ["block", "cy", "cx"]).withColumn("km", haversine_km(F.col("tlat"), F.col("tlon"), F.col("plat"), F.col("plon"))).where(F.col("km") <= max_km)
    if same:
        pairs = pairs.where(F.col("target") != F.col("point"))
    return pairs.select("target", "point", "km")


def nearest_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each target's pairs, ties by point (J-15)."""
    rank = F.row_number().over(Window.partitionBy("target").orderBy("km", "point"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_of_few(rows: DataFrame, few: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` with km to the nearest of a few reference points (J-16): one broadcast row of them, an error beyond ``most``.

    Any number of points goes through ``nearest.nearest``.  Points without a coordinate are none.
    """
    few = few.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    one = few.limit(most + 1).agg(F.collect_list(F.struct("_lat", "_lon")).alias("_few"))
    one = one.withColumn("_few", F.when(F.size("_few") <= most, F.col("_few")).otherwise(F.raise_error(F.lit(f"more than {most} reference points"))))
    km = F.array_min(F.transform("_few", lambda p: haversine_km(F.col("lat"), F.col("lon"), p["_lat"], p["_lon"])))
    return rows.crossJoin(F.broadcast(one)).withColumn("km", km).drop("_few")


def top_by_population(cities: DataFrame, n: int = 50) -> DataFrame:
    """T-02."""
    return cities.orderBy(F.col("population").desc_nulls_last(), "id").limit(n)


def nearest_in_block(points: DataFrame, centroids: DataFrame, block: str, point_id: str = "id", centroid_id: str = "id") -> DataFrame:
    """Each point's nearest centroid of its block by flat distance (J-14): a minimum by distance, no sort."""
    c = centroids.select(F.col(block).alias("block"), F.col(centroid_id).alias("centroid"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    p = points.select(F.col(block).alias("block"), F.col(point_id).alias("point"), "lat", "lon")
    d = flat_distance2(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return p.join(c, "block").groupBy("point").agg(F.min(F.struct(d.alias("d"), "centroid")).alias("m")).select("point", F.col("m.centroid").alias("centroid"))


def _crosses(edge: Column, lon: Column, lat: Column) -> Column:
    a, b = edge["a"], edge["b"]
    return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])


def inside(rings: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies in a polygon: the edges of all rings crossed by a ray are odd in number, so holes count."""
    return F.size(F.filter(_edges(rings), lambda e: _crosses(e, lon, lat))) % 2 == 1


def _edges(rings: Column) -> Column:
    """The edges of all rings, the last point of a ring joined to its first."""
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(F.get(r, i).alias("a"), F.get(r, F.pmod(i + 1, F.size(r))).alias("b")))))


def strips(polygons: DataFrame, cell: float = 0.05) -> DataFrame:
    """code, cy, edges, border, inner: each polygon by rows of cells, with the edges that reach into the row once.

    ``border`` are the columns of cells that an edge passes, ``inner`` those
    between that lie in the polygon with all of their points.
    """
    e = polygons.select("code", F.explode(_edges(F.col("rings"))).alias("e"))
    y0, y1 = F.least("e.a.lat", "e.b.lat"), F.greatest("e.a.lat", "e.b.lat")
    e = e.withColumns({"y0": y0, "y1": y1}).withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), cell), _cell(F.col("y1"), cell))))
    slope = (F.col("e.b.lon") - F.col("e.a.lon")) / F.nullif(F.col("e.b.lat") - F.col("e.a.lat"), F.lit(0.0))
    at = lambda y: F.coalesce(F.col("e.a.lon") + (y - F.col("e.a.lat")) * slope, F.col("e.a.lon"))
    low, high = at(F.greatest("y0", F.col("cy") * cell)), at(F.least("y1", (F.col("cy") + 1) * cell))
    flat = F.col("y0") == F.col("y1")  # along the row, from end to end
    x0, x1 = F.when(flat, F.least("e.a.lon", "e.b.lon")).otherwise(F.least(low, high)), F.when(flat, F.greatest("e.a.lon", "e.b.lon")).otherwise(F.greatest(low, high))
    columns = F.sequence(_cell(x0 - 1e-9, cell), _cell(x1 + 1e-9, cell))
    rows = e.withColumn("columns", columns).groupBy("code", "cy").agg(F.collect_list("e").alias("edges"), F.array_distinct(F.flatten(F.collect_list("columns"))).alias("border"))
    between = F.array_except(F.sequence(F.array_min("border"), F.array_max("border")), F.col("border"))
    odd = lambda cx: F.size(F.filter("edges", lambda e: _crosses(e, (cx + 0.5) * cell, (F.col("cy") + 0.5) * cell))) % 2 == 1
    return rows.withColumn("inner", F.filter(between, odd))


def contained(points: DataFrame, polygons: DataFrame, cell: float = 0.05) -> DataFrame:
    """point, code of the polygon that holds it, the smallest code if several (J-18).

    ``polygons`` has code and rings (array of arrays of lon, lat).  Cells carry
    no outlines: points in inner cells need no test, those in border cells meet
    the edges of their polygon's row alone.
    """
    rows = strips(polygons, cell)
    cells = rows.select("code", "cy", F.explode("inner").alias("cx"), F.lit(True).alias("sure")).unionByName(rows.select("code", "cy", F.explode("border").alias("cx"), F.lit(False).alias("sure")))
    p = points.select(F.col("id").alias("point"), "lon", "lat").withColumns({"cx": _cell(F.col("lon"), cell), "cy": _cell(F.col("lat"), cell)})
    met = p.join(cells, ["cx", "cy"])
    tested = met.where(~F.col("sure")).join(rows.select("code", "cy", "edges"), ["code", "cy"])
    tested = tested.where(F.size(F.filter("edges", lambda e: _crosses(e, F.col("lon"), F.col("lat")))) % 2 == 1)
    return met.where("sure").select("point", "code").unionByName(tested.select("point", "code")).groupBy("point").agg(F.min("code").alias("code"))


def located(points: DataFrame, polygons: DataFrame, centres: DataFrame, max_km: float = 2.0) -> DataFrame:
    """point, code, outcome: contained, near (the nearest centre up to ``max_km``) or dropped (J-19)."""
    hit = contained(points, polygons).withColumn("outcome", F.lit("contained"))
    rest = points.join(hit, points["id"] == hit["point"], "left_anti")
    near = nearest_k(near_pairs(rest, centres, max_km, point_id="code"), 1).select(F.col("target").alias("point"), F.col("point").alias("code"), F.lit("near").alias("outcome"))
    placed = hit.unionByName(near)
    return points.select(F.col("id").alias("point")).join(placed, "point", "left").withColumn("outcome", F.coalesce("outcome", F.lit("dropped")))


def idw_weight(km: Column, power: int = 1) -> Column:
    return 1 / F.pow(F.greatest(km, F.lit(0.01)), F.lit(power))


def idw_fill(cities: DataFrame, value: str = "price", k: int = 5, max_km: float = 30.0) -> DataFrame:
    """Fill a missing value from the k nearest known ones, else the department's median; column source tells which (G-01)."""
    known = cities.where(F.col(value).isNotNull())
    pairs = nearest_k(near_pairs(cities.where(F.col(value).isNull()), known, max_km), k)
    w = idw_weight(F.col("km"))
    est = pairs.join(known.select(F.col("id").alias("point"), F.col(value).alias("v")), "point").groupBy(F.col("target").alias("id")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("idw"))
    medians = known.groupBy("dept").agg(F.percentile(value, F.lit(0.5)).alias("median"))
    out = cities.join(est, "id", "left").join(medians, "dept", "left")
    source = F.when(F.col(value).isNotNull(), "observed").when(F.coalesce("idw", "median").isNotNull(), "estimated")
    return out.withColumn("source", source).withColumn(value, F.coalesce(value, "idw", "median")).drop("idw", "median")


def idw_columns(cities: DataFrame, columns: list[str], k: int = 5, max_km: float = 30.0) -> DataFrame:
    """Fill several columns at once from neighbours that have the first; each skips its own nulls, none is overwritten (G-02, S-20)."""
    known = cities.where(F.col(columns[0]).isNotNull())
    pairs = nearest_k(near_pairs(cities.where(F.col(columns[0]).isNull()), known, max_km), k).join(known.select(F.col("id").alias("point"), *columns), "point")
    w = idw_weight(F.col("km"))
    est = pairs.groupBy(F.col("target").alias("id")).agg(*[(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"_{c}") for c in columns])
    out = cities.join(est, "id", "left")
    return out.withColumn("estimated", F.col(columns[0]).isNull() & F.col(f"_{columns[0]}").isNotNull()).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def idw_series(cities: DataFrame, points: DataFrame, k: int = 5, max_km: float = 30.0, least: int = 2) -> DataFrame:
    """id, period, value estimated for cities without a series, from at least ``least`` neighbours' values of the period (J-20, G-03)."""
    real = points.select("id").distinct()
    pairs = nearest_k(near_pairs(cities.join(real, "id", "left_anti"), cities.join(real, "id", "left_semi"), max_km), k)
    enough = pairs.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("target")
    w = idw_weight(F.col("km"))
    joined = pairs.join(enough, "target").join(points.select(F.col("id").alias("point"), "period", "value"), "point")
    out = joined.groupBy(F.col("target").alias("id"), "period").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("n")


def without_stale(estimated: DataFrame, real: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates go once a real series exists (U-05)."""
    return estimated.join(real.select(*keys).distinct(), keys, "left_anti")


def idw_grid(points: DataFrame, value: str, lon: tuple[float, float], lat: tuple[float, float], steps: int, k: int = 10, max_km: float = 18.0) -> DataFrame:
    """gx, gy, lon, lat, value on a regular grid; cells without a near point are left out (G-04)."""
    spark = points.sparkSession
    at = lambda r, c: F.lit(r[0]) + F.col(c) * ((r[1] - r[0]) / (steps - 1))
    grid = spark.range(steps * steps).select("id", (F.col("id") % steps).alias("gx"), F.floor(F.col("id") / steps).alias("gy")).withColumns({"lon": at(lon, "gx"), "lat": at(lat, "gy")})
    known = points.where(F.col(value).isNotNull())
    pairs = nearest_k(near_pairs(grid, known, max_km), k).join(known.select(F.col("id").alias("point"), F.col(value).alias("v")), "point")
    w = idw_weight(F.col("km"), 2)
    est = pairs.groupBy(F.col("target").alias("id")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("value"))
    return grid.join(est, "id").select("gx", "gy", "lon", "lat", "value")
