"""Readers: explicit schemas, text first, numbers by try_cast; file names are matched by Spark's own listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import canonical_code, fold_code, parse_decimal
from marlstone.functions.codes import DISTRICTS
from marlstone.operators.rejects import quarantined

SALES_SCHEMA = "`Date mutation` date, `Nature mutation` string, `Valeur fonciere` string, `Code departement` string, `Code commune` string, `No voie` string, `Code voie` string, `Code type local` int, `Surface reelle bati` int, `Nombre pieces principales` int, `Surface terrain` int"


def sales_raw(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited sale files, no quoting; path may be a glob (S-01, U-01)."""
    return spark.read.schema(SALES_SCHEMA).option("enforceSchema", False).csv(path, sep="|", header=True, quote="", dateFormat="yyyy-MM-dd")


def sales_geo(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Gzipped sale files, all text (S-02); a gzip file is one task, so rows are dealt out at once if ``tasks`` is given."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    return df.repartition(tasks) if tasks else df


def census_years(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ";", code: str = "COM") -> DataFrame:
    """Yearly census files of one folder (S-03): the year is in the file name and, by two digits, in the columns P{yy}_X.

    ``columns`` gives the output name of each X.  Column names differ between
    years, so the files are read one year at a time and united.
    """
    names = [r["f"] for r in spark.read.format("binaryFile").load(path).select(F.col("path").alias("f")).orderBy("f").collect()]  # a row for each file
    frames = []
    for f in names:
        df = spark.read.csv(f, sep=sep, header=True, encoding="UTF-8")
        year = F.regexp_extract(F.lit(f.rsplit("/", 1)[-1]), r"(\d{4})", 1).cast("int")
        have = {c.lstrip("﻿"): c for c in df.columns}
        find = lambda x: next((have[c] for c in have if c.split("_", 1)[-1] == x and c[:1] in "PC"), None)
        cols = [(F.col(f"`{find(x)}`").try_cast("double") if find(x) else F.lit(None).cast("double")).alias(out) for x, out in columns.items()]
        frames.append(df.select(fold_code(canonical_code(F.col(f"`{have[code]}`"))).alias("city"), year.alias("year"), *cols))
    return reduce(DataFrame.unionByName, frames)


def latest_vintage(rows: DataFrame, year: str = "year", other: DataFrame | None = None) -> DataFrame:
    """Rows of the latest year, or of the latest year that a second family has as well (S-04, U-04)."""
    years = rows.select(year).distinct()
    if other is not None:
        years = years.intersect(other.select(year).distinct())
    last = years.agg(F.max(year).alias("_y"))
    return rows.join(F.broadcast(last), F.col(year) == F.col("_y"), "left_semi")


def banded(rows: DataFrame, value: Column, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is a number in the band, and the rejected ones (S-05, S-06)."""
    v = rows.withColumn("value", value.try_cast("double"))
    good = F.coalesce(F.col("value").between(low, high), F.lit(False))
    return v.where(good), v.where(~good)


def quarantined_csv(spark: SparkSession, path: str, schema: str, checks: dict[str, Column], **options) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """As ``quarantined`` over CSV files: lines that don't fit the schema have the reason ``unreadable``; ``file`` and ``line`` tell where a row comes from."""
    raw = spark.read.schema(f"{schema}, line string").csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="line", **options)
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    good, bad, counts = quarantined(raw, {"unreadable": F.col("line").isNull(), **checks})
    return good.drop("line", "file"), bad, counts


def measure_rows(rows: DataFrame, measure: str, geo_object: str = "COM", measure_col: str = "MEASURE", districts=DISTRICTS) -> DataFrame:
    """One measure at one kind of place; empty values go (S-07, A-23).  ``districts`` are folded into their cities; none of codes of another register."""
    v = F.col("OBS_VALUE").try_cast("double")
    return rows.where((F.col("GEO_OBJECT") == geo_object) & (F.col(measure_col) == measure) & v.isNotNull()).select(fold_code(canonical_code(F.col("GEO")), districts).alias("city"), v.alias("value"))


def retail(rows: DataFrame, districts=DISTRICTS) -> DataFrame:
    """Two layouts of the retail file, told apart by their header, as one (S-08); ``districts`` as in measure_rows."""
    if "GEO_OBJECT" in rows.columns:
        rows = rows.where(F.col("GEO_OBJECT") == "COM").select(F.col("GEO").alias("c"), F.col("FACILITY_DOM").alias("domain"), F.col("FACILITY_SDOM").alias("subdomain"), F.col("OBS_VALUE").alias("v"))
    else:
        rows = rows.select(F.col("DEPCOM").alias("c"), F.col("DOM").alias("domain"), F.col("SDOM").alias("subdomain"), F.col("NB_EQUIP").alias("v"))
    return rows.select(fold_code(canonical_code(F.col("c")), districts).alias("city"), "domain", "subdomain", F.col("v").try_cast("double").alias("n"))


def rents(spark: SparkSession, path: str) -> DataFrame:
    """Rent files in cp1252, which Spark reads as Latin-1, with decimal commas; the mean over codes that fold together (S-09)."""
    df = spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1")  # equal to cp1252 for codes and numbers
    return df.select(fold_code(canonical_code(F.col("INSEE_C"))).alias("city"), parse_decimal(F.col("loypredm2")).alias("rent")).where("rent is not null").groupBy("city").agg(F.avg("rent").alias("rent"))


def curated_flags(spark: SparkSession, path: str, flag: str) -> DataFrame:
    """Codes flagged TRUE in a curated file with comment lines (S-10)."""
    df = spark.read.csv(path, header=True, comment="#")
    return df.where(F.upper(F.trim(flag)) == "TRUE").select(canonical_code(F.col("insee_code")).alias("city")).distinct()


def prefixed(rows: DataFrame, prefix: str) -> Column:
    """The column whose header begins with a prefix (S-11)."""
    return F.col(f"`{next(c for c in rows.columns if c.lower().startswith(prefix.lower()))}`")


def yearly_columns(rows: DataFrame, prefix: str, code: str) -> DataFrame:
    """Columns PREFIX{year} to rows, folded and summed; years without people go (S-12, A-19)."""
    cols = [c for c in rows.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    typed = rows.select(fold_code(canonical_code(F.col(code))).alias("city"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = typed.unpivot(["city"], cols, "year", "value").withColumn("year", F.substring("year", len(prefix) + 1, 4).cast("int"))
    return long.groupBy("city", "year").agg(F.sum("value").alias("value")).where("value > 0")


COMMUNE_SCHEMA = "code string, nom string, departement struct<code:string,nom:string>, region struct<code:string,nom:string>, population long, centre struct<coordinates:array<double>>, codesPostaux array<string>"


def communes(spark: SparkSession, path: str) -> DataFrame:
    """Commune reference records (S-13)."""
    return spark.read.schema(COMMUNE_SCHEMA).json(path, multiLine=True)


def flat_communes(records: DataFrame) -> DataFrame:
    return records.select(F.col("code").alias("city"), F.col("nom").alias("name"), F.col("departement.code").alias("dept"), F.col("region.code").alias("region"), "population", F.get("centre.coordinates", F.lit(1)).alias("lat"), F.get("centre.coordinates", F.lit(0)).alias("lon"), F.get("codesPostaux", F.lit(0)).alias("postal_code"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Feature collection to code, rings and a representative point inside (S-14)."""
    schema = "features array<struct<properties:struct<code:string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.code", "f.geometry.type", "f.geometry.coordinates").where("coordinates is not null")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    rings = F.flatten(F.when(F.col("type") == "MultiPolygon", many).otherwise(one))
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))))
    out = f.select("code", points.alias("rings")).where(F.size("rings") > 0)
    return out.withColumn("_in", point_inside(F.col("rings"))).select("code", "rings", "_in.lat", "_in.lon")


def point_inside(rings: Column) -> Column:
    """Struct of lat and lon within a polygon: the middle of its widest stretch along a parallel.

    The parallel runs half-way between two neighbouring latitudes of vertices
    near the middle of the ring with the largest box, so that it touches no
    vertex of it; edges of all rings cross it in pairs, and holes are left
    out.  Without height it is the mean of the vertices.
    """
    points = F.flatten(rings)
    side = lambda r, c: F.array_max(F.transform(r, lambda p: p[c])) - F.array_min(F.transform(r, lambda p: p[c]))
    main = F.array_max(F.transform(rings, lambda r: F.struct((side(r, "lon") * side(r, "lat")).alias("size"), r.alias("ring"))))["ring"]
    lats = F.array_sort(F.array_distinct(F.transform(main, lambda p: p["lat"])))
    k = F.greatest(F.floor(F.size(lats) / 2).cast("int"), F.lit(1))
    edges = F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(F.get(r, i).alias("a"), F.get(r, F.pmod(i + 1, F.size(r))).alias("b")))))

    def at(lat: Column) -> Column:
        met = F.filter(edges, lambda e: (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
        xs = F.array_sort(F.transform(met, lambda e: e["a"]["lon"] + (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) * (e["b"]["lon"] - e["a"]["lon"])))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 2, F.lit(0)), F.lit(2)), lambda i: F.struct((F.get(xs, i + 1) - F.get(xs, i)).alias("width"), ((F.get(xs, i + 1) + F.get(xs, i)) / 2).alias("lon")))
        return F.array_max(pairs)["lon"]

    middle = (F.get(lats, k - 1) + F.get(lats, k)) / 2
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[c]) / F.size(points)
    flat = F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))
    return F.when(F.size(lats) < 2, flat).otherwise(F.struct(middle.alias("lat"), at(middle).alias("lon")))


def serie_points(points: DataFrame, name: str, level: str, cities: DataFrame | None = None, dept: str | None = None) -> DataFrame:
    """Points of one serie at one level, of one department if given (S-15): filters reach the scan."""
    out = points.where((F.col("serie_name") == name) & (F.col("geo_level") == level))
    if dept is not None and cities is not None:
        out = out.join(cities.where(F.col("dept") == dept).select(F.col("city").alias("geo_code")), "geo_code", "left_semi")
    return out


def latest_rates(rows: DataFrame, code: str, year: str, rate: str) -> DataFrame:
    """Rates of the latest exercise; the smallest of several for a code (S-26)."""
    last = rows.agg(F.max(year).alias("_y"))
    return rows.join(F.broadcast(last), F.col(year) == F.col("_y"), "left_semi").where(F.col(rate).isNotNull()).groupBy(F.col(code).alias("city")).agg(F.min(rate).alias("rate"))


#: Seven density levels to five groups (fixed values).
DENSITY_GROUPS = {1: "urban", 2: "urban_mid", 3: "urban_mid", 4: "small_towns", 5: "rural_near", 6: "rural_far", 7: "rural_far"}


def density_group(level: Column) -> Column:
    """S-27."""
    return F.create_map(*[x for k, v in DENSITY_GROUPS.items() for x in (F.lit(k), F.lit(v))])[level]
