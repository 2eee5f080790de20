"""Places: points of interest, name resolution, source priority and known codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import name_key, strip_parenthesis
from marlstone.operators.staging import staged

#: Tag values and what they are, in the order in which tags decide (fixed values).
TAGS = (
    ("amenity", {"education": ("school", "kindergarten", "college", "university"), "health": ("hospital", "clinic", "doctors", "pharmacy", "dentist"), "transport": ("bus_station", "ferry_terminal"), "culture": ("library", "theatre", "cinema"), "services": ("post_office", "bank", "police", "fire_station", "townhall")}),
    ("railway", {"transport": ("station", "halt", "tram_stop")}),
    ("aeroway", {"transport": ("aerodrome",)}),
    ("shop", {"shopping": ("supermarket", "mall", "department_store")}),
    ("tourism", {"culture": ("museum",)}),
    ("leisure", {"leisure": ("sports_centre", "stadium", "park")}),
)
RENAMED = {("railway", "station"): "train_station", ("railway", "halt"): "train_halt", ("aeroway", "aerodrome"): "airport"}


def poi_class(tags: Column) -> Column:
    """Struct of category and type of a tag map, or null; the first tag that decides wins (P-13)."""
    out = []
    for key, groups in TAGS:
        value = F.try_element_at(tags, F.lit(key))
        for category, values in groups.items():
            kind = value
            for v in values:
                if (key, v) in RENAMED:
                    kind = F.when(value == v, RENAMED[key, v]).otherwise(kind)
            out.append(F.when(value.isin(*values), F.struct(F.lit(category).alias("category"), kind.alias("type"))))
    return F.coalesce(*out)


def pois(records: DataFrame) -> DataFrame:
    """Points with a class, a name and a coordinate (P-13, P-14)."""
    name = F.trim(F.try_element_at("tags", F.lit("name")))
    rows = records.select("osm_id", poi_class(F.col("tags")).alias("c"), name.alias("name"), "lat", "lon")
    return rows.where(F.col("c").isNotNull() & (F.length("name") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("osm_id", "c.category", "c.type", "name", "lat", "lon")


def way_centres(ways: DataFrame) -> DataFrame:
    """Ways as points: the mean of their valid nodes, ids negative (P-15)."""
    good = F.filter("nodes", lambda n: n["lat"].isNotNull() & n["lon"].isNotNull())
    mean = lambda c: F.aggregate(good, F.lit(0.0), lambda a, n: a + n[c]) / F.size(good)
    return ways.where(F.size(good) > 0).select((-F.col("osm_id")).alias("osm_id"), "tags", mean("lat").alias("lat"), mean("lon").alias("lon"))


def known_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """J-06."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """J-05, U-03."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def by_priority(sources: list[DataFrame], keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Union in which the earlier source wins a key (J-24, S-24, U-06)."""
    rows = None
    for k, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(k))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("priority", *(order or []))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _heads(keys: DataFrame, shortest: int) -> DataFrame:
    """Rows once for each beginning of their key, of ``shortest`` letters at least and shorter than the key: column head."""
    lengths = F.sequence(F.lit(shortest), F.length("key") - 1)
    return keys.where(F.length("key") > shortest).withColumn("_n", F.explode(lengths)).withColumn("head", F.expr("substring(key, 1, _n)")).drop("_n")


def resolve(names: DataFrame, places: DataFrame, shortest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Names (name, hint) to places (code, name, dept, population); the resolved with their confidence and kind of match, and the rest (J-25).

    An exact key decides, within the hinted department if there is a hint, the
    most populous of several.  Without a hint a name that starts another's key
    is taken with low confidence; the shorter has ``shortest`` letters at least.

    Places are reduced to the best of each key before names meet them, and
    beginnings are joined as values: a name meets one row for each of its
    letters, however many places begin alike.  The matches are staged once.
    """
    n = names.select("name", "hint", name_key(strip_parenthesis(F.col("name"))).alias("key")).distinct()
    order = F.struct(F.col("population").isNull().alias("unknown"), (-F.col("population")).alias("less"), "code")
    in_dept = places.select("dept", order.alias("best"), name_key(F.col("name")).alias("key")).groupBy("key", "dept").agg(F.min("best").alias("best"), F.count("*").alias("found"))
    anywhere = in_dept.groupBy("key").agg(F.min("best").alias("best"), F.sum("found").alias("found"))
    exact = in_dept.where("dept is not null").unionByName(anywhere.withColumn("dept", F.lit(None).cast(in_dept.schema["dept"].dataType)))

    asked = n.where("hint is null").select("key").distinct().where(F.length("key") >= shortest).join(anywhere, "key", "left_anti")
    longer = _heads(anywhere.select("key", "best"), shortest).groupBy(F.col("head").alias("key")).agg(F.min("best").alias("best"))
    shorter = _heads(asked, shortest).join(anywhere.select(F.col("key").alias("head"), "best"), "head")
    near = asked.join(longer, "key").select("key", "best").unionByName(shorter.select("key", "best")).groupBy("key").agg(F.min("best").alias("near"))

    e = exact.select(F.col("key").alias("_key"), F.col("dept").alias("_dept"), "best", "found")
    m = n.join(e, (F.col("key") == F.col("_key")) & F.col("hint").eqNullSafe(F.col("_dept")), "left").join(near.withColumn("hint_free", F.lit(True)), "key", "left")
    loose = F.col("hint_free") & F.col("hint").isNull()
    level = F.when(F.col("found") > 1, "low").when(F.col("found").isNull(), "low").when(F.col("hint").isNotNull(), "high").otherwise("medium")
    kind = F.when(F.col("found").isNotNull(), "exact").when(loose, "prefix")
    m = staged(m.select("name", "hint", F.coalesce("best.code", F.when(loose, F.col("near.code"))).alias("code"), level.alias("confidence"), kind.alias("match")))
    return m.where("match is not null"), m.where("match is null").select("name", "hint")


def category_counts(pois_in_city: DataFrame, cities: DataFrame, categories: list[str]) -> DataFrame:
    """Points of each category per city, 0 where there are none, and their number for 1000 inhabitants (A-31)."""
    wide = pois_in_city.groupBy("city").pivot("category", categories).count()
    out = cities.join(wide, "city", "left").na.fill(0, categories)
    total = sum((F.col(c) for c in categories), F.lit(0))
    return out.withColumn("per_1000", F.when(F.col("population") > 0, total * 1000.0 / F.col("population")))


def in_box(rows: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Rows within a box of degrees, such as the mainland's (P-19)."""
    return rows.where(F.col("lon").between(*lon) & F.col("lat").between(*lat))


def without_departments(rows: DataFrame, heads: tuple[str, ...] = ("97", "98"), dept: str = "dept") -> DataFrame:
    """Rows outside the departments that start so, overseas ones by default; unknown departments stay (P-20)."""
    out = F.lit(False)
    for h in heads:
        out |= F.coalesce(F.startswith(dept, F.lit(h)), F.lit(False))
    return rows.where(~out)


def known_codes(sets: list[DataFrame], key: str) -> DataFrame:
    """Codes that any of the sets has (U-02)."""
    rows = sets[0].select(key)
    for s in sets[1:]:
        rows = rows.union(s.select(key))
    return rows.distinct()


def with_context(rows: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Rows of places that have a context, with its columns (J-23)."""
    return rows.join(context, key)


def named(rows: DataFrame, dimension: DataFrame, key: str, name: str) -> DataFrame:
    """A missing name is that of the dimension (J-26)."""
    return backfilled(rows, dimension.select(key, name), key)


def backfilled(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Nulls of the columns that ``other`` has too come from it (J-13); its keys are single."""
    cols = [c for c in other.columns if c != key and c in rows.columns]
    j = rows.join(other.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols]), key, "left")
    return j.select(*[F.coalesce(c, f"_o_{c}").alias(c) if c in cols else F.col(c) for c in rows.columns])


def feature_table(base: DataFrame, parts: list[DataFrame], key: str, zero: tuple[str, ...] = ()) -> DataFrame:
    """All places with the columns of each part (J-12); counts in ``zero`` are 0 where a part lacks the place."""
    for p in parts:
        base = base.join(p, key, "left")
    return base.na.fill(0, list(zero)) if zero else base
