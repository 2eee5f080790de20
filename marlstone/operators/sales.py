"""Sale records: cleaning, mutations and quarterly series.

One scan serves the four geographic levels: rows are exploded to (level, code)
pairs.  Medians of regions and of the country, whose groups grow with the
table, are ranked within a bracket instead of gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import canonical_code, commune_code, fold_code, parse_decimal, quarter_start, steady_mean, typology
from marlstone.operators.ranks import exact_quantile, exact_quantiles

UNIT_TYPES = {1: "HOUSE", 2: "APARTMENT", 4: "COMMERCIAL"}


@dataclass(frozen=True)
class Bounds:
    """Plausible surfaces and prices per unit of surface."""

    low_surface: float = 9
    high_surface: float = 2000
    high_surface_one: float = 500
    low_price: float = 500
    high_price: float = 30000


def clean_sales(raw: DataFrame) -> DataFrame:
    """Raw sale rows to typed rows with a mutation key (D2: P-01, P-02, P-04, J-01)."""
    price = F.replace("Valeur fonciere", F.lit(","), F.lit("."))
    key = F.md5(F.concat_ws("|", F.col("Date mutation").cast("string"), price, "Code departement", F.col("Code commune").cast("string"), F.col("No voie").cast("string"), "Code voie"))
    return raw.where(F.col("Date mutation").isNotNull()).select(
        F.col("Date mutation").alias("mutation_date"), F.col("Nature mutation").alias("nature"), parse_decimal(F.col("Valeur fonciere")).alias("price"), F.col("Code departement").alias("dept"),
        fold_code(commune_code(F.col("Code departement"), F.col("Code commune"))).alias("city"), F.col("Code type local").alias("unit_type"), F.col("Surface reelle bati").cast("double").alias("surface"),
        F.col("Nombre pieces principales").alias("rooms"), F.col("Surface terrain").cast("double").alias("land"), key.alias("mutation_id"),
    )


def mutation_prices(units: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Units of one type and room count of a mutation, with the mutation's totals (A-09, J-03).

    The total price stands on every unit, so it is taken once.  The totals are
    window sums over the grouped rows: both steps share one shuffle by mutation.
    """
    base = units.where(F.col("unit_type").isin(1, 2) & (F.col("surface") > 0))
    keys = ["mutation_id", "mutation_date", "nature", "dept", "city", *keep]
    groups = base.repartition("mutation_id").groupBy(*keys, "unit_type", "rooms").agg(F.max("price").alias("price"), F.sum("surface").alias("surface"), F.count("*").alias("n_units"))
    whole = Window.partitionBy("mutation_id")
    return groups.withColumns({"all_units": F.sum("n_units").over(whole), "n_types": F.size(F.collect_set("unit_type").over(whole))})


def with_mutation_units(units: DataFrame) -> DataFrame:
    """Every unit with the number of units of its mutation, all_units (J-03, W-11)."""
    return units.withColumn("all_units", F.count("*").over(Window.partitionBy("mutation_id")))


def distinct_units(units: DataFrame, identifying: tuple[str, ...]) -> DataFrame:
    """One row for each combination of the identifying columns (P-11)."""
    return units.select(*identifying).distinct()


def mutation_land(units: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Land sold with a mutation (D4)."""
    base = units.where((F.col("land") > 0) & (F.col("price") > 0))
    return base.groupBy("mutation_id", "mutation_date", "nature", "dept", "city", *keep).agg(F.max("price").alias("price"), F.sum("land").alias("land"))


def many_units(b: Bounds = Bounds()) -> Column:
    """All units of the mutation alike, with plausible surface and price (P-05)."""
    return (F.col("n_types") == 1) & (F.col("all_units") == F.col("n_units")) & F.col("surface").between(b.low_surface, b.high_surface) & (F.col("price") > 0) & (F.col("price") / F.col("surface")).between(b.low_price, b.high_price)


def one_kind(b: Bounds = Bounds()) -> Column:
    """As many_units, for series of one size class (P-06)."""
    return (F.col("all_units") == F.col("n_units")) & F.col("surface").between(b.low_surface, b.high_surface_one) & (F.col("price") > 0) & (F.col("price") / F.col("surface")).between(b.low_price, b.high_price)


LEVELS = {"city": "city", "department": "dept", "region": "region"}


def at_levels(rows: DataFrame, levels: dict[str, str] | None = None, country: str = "FR") -> DataFrame:
    """Each row once for each geographic level, as (geo_level, geo_code) (A-02)."""
    pairs = [F.struct(F.lit(name).alias("geo_level"), F.col(col).cast("string").alias("geo_code")) for name, col in (LEVELS if levels is None else levels).items()]
    if country:
        pairs.append(F.struct(F.lit("country").alias("geo_level"), F.lit(country).alias("geo_code")))
    return rows.select("*", F.explode(F.array(*pairs)).alias("_geo")).select("*", "_geo.geo_level", "_geo.geo_code").drop("_geo")


def series(rows: DataFrame, value: Column, least: int, by: tuple[str, ...] = (), key: str = "mutation_id", day: str = "mutation_date") -> DataFrame:
    """geo_level, geo_code, period, value, n_sales of rows at their levels (A-01); a period needs ``least`` different sales."""
    grouped = rows.where(F.col("geo_code").isNotNull()).groupBy("geo_level", "geo_code", quarter_start(F.col(day)).alias("period"), *by).agg(value.alias("value"), F.count_distinct(key).alias("n_sales"))
    return grouped.where((F.col("n_sales") >= least) & F.col("value").isNotNull())


def median(x: Column | str, accuracy: int | None = None) -> Column:
    """Median: exact and interpolated, or within 1/accuracy of the rank.

    The exact one holds a group's distinct values in one task: see median_series for groups of any size.
    """
    return F.percentile(x, F.lit(0.5)) if accuracy is None else F.percentile_approx(x, F.lit(0.5), F.lit(accuracy))


#: Levels whose groups grow with the whole table.
WIDE = ("region", "country")


def median_series(rows: DataFrame, value: Column, least: int, by: tuple[str, ...] = (), accuracy: int | None = None, single: bool = False, key: str = "mutation_id", day: str = "mutation_date") -> DataFrame:
    """As series, with the median of ``value``.

    Cities and departments are small groups with a percentile each; regions
    and the country are ranked within a bracket.  ``single`` says that a sale
    is one row, so that rows are counted instead of different keys.
    """
    keys = ["geo_level", "geo_code", "period", *by]
    rows = rows.where(F.col("geo_code").isNotNull()).select("geo_level", "geo_code", quarter_start(F.col(day)).alias("period"), *by, key, value.alias("value"))
    wide = F.col("geo_level").isin(*WIDE)
    few = rows.where(~wide) if accuracy is None else rows
    out = few.groupBy(*keys).agg(median("value", accuracy).alias("value"), F.count("*").alias("n_sales"))
    if accuracy is None:
        many = exact_quantile(rows.where(wide), keys, "value").select(*keys, F.col("quantile").alias("value"), F.col("n").alias("n_sales"))
        out = out.unionByName(many)
    if not single:
        sold = rows.select(*keys, key).distinct().groupBy(*keys).agg(F.count(key).alias("n_sales"))
        out = out.drop("n_sales").join(sold, keys)
    return out.where((F.col("n_sales") >= least) & F.col("value").isNotNull()).select("geo_level", "geo_code", "period", *by, "value", "n_sales")


def price_series(prices: DataFrame, least: int, bounds: Bounds = Bounds(), unit_type: int | None = None, accuracy: int | None = None) -> DataFrame:
    """Median price for a unit of surface (A-03); a sale of alike units is one row."""
    base = prices.where(many_units(bounds))
    if unit_type is not None:
        base = base.where(F.col("unit_type") == unit_type)
    return median_series(base, F.col("price") / F.col("surface"), least, accuracy=accuracy, single=True)


def price_by_size(prices: DataFrame, least: int, bounds: Bounds = Bounds(), accuracy: int | None = None) -> DataFrame:
    """Median price for each size class (A-04): one pass for all four."""
    base = prices.where(one_kind(bounds)).withColumn("size_class", typology(F.col("rooms"))).where(F.col("size_class").isNotNull())
    return median_series(base, F.col("price") / F.col("surface"), least, ("size_class",), accuracy, single=True)


def surface_by_size(units: DataFrame, least: int, accuracy: int | None = None) -> DataFrame:
    """Median surface of units for each size class (A-05)."""
    base = units.where(F.col("unit_type").isin(1, 2) & (F.col("surface") > 0)).withColumn("size_class", typology(F.col("rooms"))).where(F.col("size_class").isNotNull())
    return median_series(base, F.col("surface"), least, ("size_class",), accuracy)


def each_sale_once(units: DataFrame, keep: tuple[str, ...] = ("region",)) -> DataFrame:
    """One row for each sale, place and kept column: counting starts from these, before levels multiply them."""
    return units.select("mutation_id", "mutation_date", "nature", "dept", "city", *keep).distinct()


def volume(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Different sales (A-06, A-10)."""
    return series(rows, F.count_distinct("mutation_id"), 1, by)


def share_of_nature(rows: DataFrame, nature: str, least: int) -> DataFrame:
    """Percentage of sales of a nature, among all (A-07)."""
    some, every = F.count_distinct(F.when(F.col("nature") == nature, F.col("mutation_id"))), F.count_distinct("mutation_id")
    return series(rows, some * 100.0 / F.nullif(every, F.lit(0)), least)


def land_price(land: DataFrame, least: int, accuracy: int | None = None) -> DataFrame:
    """Median price for a unit of land (A-08)."""
    return median_series(land, F.col("price") / F.col("land"), least, accuracy=accuracy)


def with_regions(rows: DataFrame, departments: DataFrame) -> DataFrame:
    """Rows with the region of their department (dept, region); null where it is unknown (J-02)."""
    return rows.join(departments.select("dept", "region").distinct(), "dept", "left")


def since_latest(sales: DataFrame, months: int = 12) -> DataFrame:
    """Sales of the months before the latest of all (J-08); the latest day is one row, which is broadcast."""
    last = sales.agg(F.add_months(F.max("mutation_date"), -months).alias("_since"))
    return sales.crossJoin(F.broadcast(last)).where(F.col("mutation_date") > F.col("_since")).drop("_since")


def national_by_type(prices: DataFrame, least: int = 3, bounds: Bounds = Bounds()) -> DataFrame:
    """Quarterly medians of the whole country for each type and size class (A-38)."""
    base = prices.where(one_kind(bounds)).select("unit_type", typology(F.col("rooms")).alias("size_class"), quarter_start(F.col("mutation_date")).alias("period"), (F.col("price") / F.col("surface")).alias("value"))
    out = exact_quantile(base, ["unit_type", "size_class", "period"], "value")
    return out.where(F.col("n") >= least).select("unit_type", "size_class", "period", F.col("quantile").alias("value"))


def panel(prices: DataFrame, volumes: DataFrame, keys: tuple[str, ...] = ("geo", "period")) -> DataFrame:
    """Prices and volumes of places and periods side by side, from either (J-11)."""
    return prices.join(volumes, list(keys), "full")


def sales_mix(sales: DataFrame, by: str, kind: str, surface: str, house: str = "HOUSE", commercial: str = "COMMERCIAL", lots: str = "lots") -> DataFrame:
    """Shares of houses, commercial units and sales of several lots, and the mean surface, of each place (A-32)."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return sales.groupBy(by).agg(share(F.col(kind) == house).alias("house_share"), share(F.col(kind) == commercial).alias("commercial_share"), share(F.col(lots) > 1).alias("bloc_share"), F.avg(surface).alias("mean_surface"))


def observations(prices: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Sales as observations for models (P-24)."""
    return prices.where(many_units(bounds)).select("city", "dept", quarter_start(F.col("mutation_date")).alias("period"), "unit_type", "rooms", "surface", (F.col("price") / F.col("surface")).alias("price_sqm"))


def single_unit_sales(units: DataFrame) -> DataFrame:
    """Sales of one house or apartment alone: city, year and price for a unit of surface (P-25)."""
    return with_mutation_units(units).where((F.col("all_units") == 1) & F.col("unit_type").isin(1, 2) & (F.col("surface") > 0)).select("city", F.year("mutation_date").alias("year"), (F.col("price") / F.col("surface")).alias("price_sqm"))


def _with_quantiles(groups: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with p, the 10 %, 50 % and 90 % quantiles of the price, and s, the 10 % and 90 % ones of that for a unit of surface."""
    p = exact_quantiles(rows, keys, "price", [0.1, 0.5, 0.9]).select(*keys, F.col("quantiles").alias("p"))
    s = exact_quantiles(rows, keys, "sqm", [0.1, 0.9]).select(*keys, F.col("quantiles").alias("s"))
    return groups.join(p, keys, "left").join(s, keys, "left")


def latest_year_snapshot(sales: DataFrame, least: int = 10) -> DataFrame:
    """City prices over the 12 months before the latest sale of all (A-11, J-08)."""
    recent = since_latest(sales)
    sqm = F.col("price") / F.col("surface")
    out = recent.groupBy("city").agg(F.count("*").alias("n_sales"), steady_mean(F.col("price")).alias("avg_price")).where(F.col("n_sales") >= least)
    out = _with_quantiles(out, recent.withColumn("sqm", sqm), ["city"])
    return out.select("city", "n_sales", "avg_price", F.col("p")[1].alias("median_price"), F.col("p")[0].alias("price_p10"), F.col("p")[2].alias("price_p90"), F.col("s")[0].alias("sqm_p10"), F.col("s")[1].alias("sqm_p90"))


def rolling_quarters(sales: DataFrame) -> DataFrame:
    """Each sale once for each of the four quarters whose 12 months hold it (J-07), as column quarter.

    A join of quarters with sales by range would compare all with all; each
    sale names its quarters instead.  Quarters are full from the fourth on.
    """
    q = F.trunc("mutation_date", "quarter")
    span = sales.agg(F.add_months(F.trunc(F.min("mutation_date"), "quarter"), 9).alias("first"), F.trunc(F.max("mutation_date"), "quarter").alias("last"))
    each = sales.withColumn("quarter", F.explode(F.array(*[F.add_months(q, m) for m in (0, 3, 6, 9)])))
    return each.crossJoin(F.broadcast(span)).where(F.col("quarter").between(F.col("first"), F.col("last"))).drop("first", "last")


def rolling_ranges(sales: DataFrame, least: int = 10) -> DataFrame:
    """Seven series of price ranges over rolling 12 months, long form (A-12)."""
    sqm = F.col("price") / F.col("surface")
    rows = rolling_quarters(sales).withColumn("sqm", sqm)
    g = rows.groupBy("city", "quarter").agg(F.count("*").alias("n_sales"), F.avg("sqm").alias("sqm_avg"), F.avg("price").alias("price_avg"))
    g = _with_quantiles(g.where(F.col("n_sales") >= least), rows, ["city", "quarter"]).select("city", "quarter", F.col("s")[0].alias("sqm_p10"), "sqm_avg", F.col("s")[1].alias("sqm_p90"), F.col("p")[0].alias("price_p10"), F.col("p")[1].alias("price_p50"), F.col("p")[2].alias("price_p90"), "price_avg")
    return g.unpivot(["city", "quarter"], ["sqm_p10", "sqm_avg", "sqm_p90", "price_p10", "price_p50", "price_p90", "price_avg"], "serie", "value")


def staged_sales(raw: DataFrame) -> DataFrame:
    """Geolocated sale rows (all text) to unit sales (P-07, P-09..P-12, W-11).

    Repeated rows go before any price filter, so the count of units per sale
    is that of the distinct ones.
    """
    raw = raw.distinct()
    price, surface, kind = F.col("valeur_fonciere").try_cast("double"), F.col("surface_reelle_bati").try_cast("double"), F.col("code_type_local").try_cast("int")
    kinds = F.create_map(*[x for k, v in UNIT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    base = raw.where(F.col("nature_mutation").isin("Vente", "Vente en l'état futur d'achèvement") & kind.isin(*UNIT_TYPES) & price.between(1_000, 500_000_000) & surface.between(5, 50_000))
    address = F.when(F.col("adresse_nom_voie").isNotNull(), F.trim(F.concat_ws(" ", "adresse_numero", "adresse_suffixe", "adresse_nom_voie")))
    return base.select(
        F.col("id_mutation").alias("mutation_id"), F.col("date_mutation").try_cast("date").alias("mutation_date"), price.alias("price"), address.alias("address"), F.col("code_postal").alias("postal_code"),
        fold_code(canonical_code(F.col("code_commune"))).alias("city"), kinds[kind].alias("property_type"), surface.alias("surface"),
        F.count("*").over(Window.partitionBy("id_mutation")).alias("lots_in_mutation"), F.col("longitude").try_cast("double").alias("lon"), F.col("latitude").try_cast("double").alias("lat"),
    )
