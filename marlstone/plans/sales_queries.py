"""Queries of the sale, series, window and pooling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import rounded
from marlstone.operators import sales as S
from marlstone.operators import windows as W
from marlstone.plans.standins import CITIES, CLEAN, MANY, ONE, POINTS, PRICES, QUERIES, SALES, SQL, UNITS, cities, haversine, levels, points, query, sales, table, units


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return S.at_levels(S.mutation_prices(units(spark, d), ("region",)))


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in cols})


_SERIES = "SELECT geo_level, geo_code, CAST(date_trunc('quarter', mutation_date) AS DATE) AS period, {by}round({value}, 6) AS value, count(DISTINCT mutation_id) AS n_sales FROM {x} WHERE {where} GROUP BY ALL HAVING count(DISTINCT mutation_id) >= {least} AND {value} IS NOT NULL"


def _series_sql(value: str, x: str, where: str, least: int, by: str = "") -> str:
    return _SERIES.format(value=value, x=x, where=where, least=least, by=by)


@query(f"WITH {PRICES} " + _series_sql("quantile_cont(price / surface, 0.5)", levels("prices"), MANY, 3))
def a03_price_sqm_all(spark, d):
    return _rounded(S.price_series(_prices(spark, d), 3), "value")


@query(f"WITH {PRICES} " + _series_sql("quantile_cont(price / surface, 0.5)", levels("prices"), MANY + " AND unit_type = 1", 2))
def a03_price_sqm_house(spark, d):
    return _rounded(S.price_series(_prices(spark, d), 2, unit_type=1), "value")


_SIZE = "CASE WHEN rooms <= 1 THEN 1 WHEN rooms >= 4 THEN 4 ELSE rooms END"


@query(f"WITH {PRICES} " + _series_sql("quantile_cont(price / surface, 0.5)", levels("prices"), ONE, 2, _SIZE + " AS size_class, "))
def a04_price_by_size(spark, d):
    return _rounded(S.price_by_size(_prices(spark, d), 2), "value")


@query(f"WITH {UNITS} " + _series_sql("quantile_cont(surface, 0.5)", levels("units"), "surface > 0", 5, _SIZE + " AS size_class, "))
def a05_surface_by_size(spark, d):
    return _rounded(S.surface_by_size(S.at_levels(units(spark, d)), 5), "value")


@query(f"WITH {UNITS} " + _series_sql("count(DISTINCT mutation_id)", levels("units"), "TRUE", 1).replace("round(count(DISTINCT mutation_id), 6)", "count(DISTINCT mutation_id)"))
def a06_transaction_volume(spark, d):
    return S.volume(S.at_levels(S.each_sale_once(units(spark, d))))


@query(f"WITH {UNITS} " + _series_sql("count(DISTINCT CASE WHEN nature = 'O' THEN mutation_id END) * 100.0::DOUBLE / count(DISTINCT mutation_id)", levels("units"), "TRUE", 5))
def a07_off_plan_share(spark, d):
    return _rounded(S.share_of_nature(S.at_levels(S.each_sale_once(units(spark, d))), "O", 5), "value")


@query(f"WITH {UNITS}, land AS (SELECT mutation_id, mutation_date, nature, dept, city, region, max(price) AS price, sum(land) AS land FROM units WHERE land > 0 AND price > 0 GROUP BY ALL) " + _series_sql("quantile_cont(price / land, 0.5)", levels("land"), "TRUE", 5))
def a08_land_price(spark, d):
    return _rounded(S.land_price(S.at_levels(S.mutation_land(units(spark, d), ("region",))), 5), "value")


@query(f"WITH {PRICES} SELECT mutation_id, city, unit_type, rooms, round(price, 6) AS price, surface, n_units, all_units, n_types FROM prices")
def a09_mutation_prices(spark, d):
    p = S.mutation_prices(units(spark, d), ("region",))
    return p.select("mutation_id", "city", "unit_type", "rooms", F.round("price", 6).alias("price"), "surface", "n_units", "all_units", F.col("n_types").cast("long").alias("n_types"))


@query(f"WITH {UNITS} SELECT geo_level, geo_code, CAST(date_trunc('quarter', mutation_date) AS DATE) AS period, count(*) AS n, round(max(price), 6) AS top FROM {levels('units')} GROUP BY ALL")
def a02_four_levels(spark, d):
    return S.at_levels(units(spark, d)).groupBy("geo_level", "geo_code", F.trunc("mutation_date", "quarter").alias("period")).agg(F.count("*").alias("n"), F.round(F.max("price"), 6).alias("top"))


@query(f"WITH {UNITS} SELECT geo_code, geo_level, CAST(date_trunc('quarter', mutation_date) AS DATE) AS period, {_SIZE} AS size_class, count(DISTINCT mutation_id) AS value, count(DISTINCT mutation_id) AS n_sales FROM (SELECT *, 'city' AS geo_level, city AS geo_code FROM units) GROUP BY ALL")
def a10_volume_by_size(spark, d):
    u = S.at_levels(units(spark, d), {"city": "city"}, country="").withColumn("size_class", S.typology(F.col("rooms")))
    return S.volume(u, ("size_class",))


@query(f"""WITH {SALES}, last AS (SELECT max(mutation_date) - INTERVAL 12 MONTH AS since FROM sales)
SELECT city, count(*) AS n_sales, round(avg(price), 6) AS avg_price, round(quantile_cont(price, 0.5), 6) AS median_price, round(quantile_cont(price, 0.1), 6) AS price_p10, round(quantile_cont(price, 0.9), 6) AS price_p90,
round(quantile_cont(price / surface, 0.1), 6) AS sqm_p10, round(quantile_cont(price / surface, 0.9), 6) AS sqm_p90 FROM sales, last WHERE mutation_date > since GROUP BY city HAVING count(*) >= 5""")
def a11_city_snapshot(spark, d):
    return _rounded(S.latest_year_snapshot(sales(spark, d), 5), "avg_price", "median_price", "price_p10", "price_p90", "sqm_p10", "sqm_p90", digits=6)


@query(f"""WITH {SALES}, q AS (SELECT DISTINCT CAST(date_trunc('quarter', mutation_date) AS DATE) AS quarter FROM sales WHERE date_trunc('quarter', mutation_date) >= (SELECT date_trunc('quarter', min(mutation_date)) + INTERVAL 9 MONTH FROM sales)),
g AS (SELECT city, quarter, count(*) AS n, quantile_cont(price / surface, 0.1) AS sqm_p10, avg(price / surface) AS sqm_avg, quantile_cont(price / surface, 0.9) AS sqm_p90, quantile_cont(price, 0.1) AS price_p10, quantile_cont(price, 0.5) AS price_p50, quantile_cont(price, 0.9) AS price_p90, avg(price) AS price_avg
  FROM sales JOIN q ON mutation_date >= quarter - INTERVAL 9 MONTH AND mutation_date < quarter + INTERVAL 3 MONTH GROUP BY ALL HAVING count(*) >= 10)
SELECT city, quarter, serie, round(value, 6) AS value FROM (UNPIVOT (SELECT * EXCLUDE (n) FROM g) ON sqm_p10, sqm_avg, sqm_p90, price_p10, price_p50, price_p90, price_avg INTO NAME serie VALUE value)""")
def a12_rolling_ranges(spark, d):
    return _rounded(S.rolling_ranges(sales(spark, d)), "value", digits=6)


@query(f"WITH {SALES} SELECT quarter, count(*) AS n FROM (SELECT CAST(date_trunc('quarter', mutation_date) AS DATE) + INTERVAL (m) MONTH AS quarter FROM sales, (VALUES (0), (3), (6), (9)) t(m)) WHERE quarter BETWEEN (SELECT date_trunc('quarter', min(mutation_date)) + INTERVAL 9 MONTH FROM sales) AND (SELECT date_trunc('quarter', max(mutation_date)) FROM sales) GROUP BY 1".replace("SELECT quarter, count", "SELECT CAST(quarter AS DATE) AS quarter, count"))
def j07_rolling_quarters(spark, d):
    return S.rolling_quarters(sales(spark, d)).groupBy("quarter").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label, lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS code, replace(replace(CAST(o_totalprice AS DECIMAL(18, 2))::VARCHAR, '.', ','), ',', '.')::DOUBLE AS parsed, md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus)) AS key FROM orders")
def p01_p02_p04_f01_f04_parsing(spark, d):
    from marlstone.functions import commune_code, parse_decimal, quarter_label, quarter_start

    o = table(spark, d, "orders")
    comma = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), quarter_start(F.to_date("o_orderdate")).alias("quarter"), quarter_label(F.col("o_orderdate")).alias("label"), commune_code(F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.col("o_orderkey") % 1000).alias("code"), parse_decimal(comma).alias("parsed"), F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit(None).cast("string"), "o_orderstatus")).alias("key"))


@query("SELECT DISTINCT CASE WHEN length(trim(c)) < 5 THEN lpad(trim(c), 5, '0') ELSE trim(c) END AS canonical, CASE WHEN x BETWEEN 75101 AND 75120 THEN '75056' WHEN x BETWEEN 69381 AND 69389 THEN '69123' WHEN x BETWEEN 13201 AND 13216 THEN '13055' ELSE x::VARCHAR END AS folded FROM (SELECT ' ' || CAST(p_partkey AS VARCHAR) || ' ' AS c, 75090 + p_partkey % 40 AS x FROM part)")
def p03_j01_code_folding(spark, d):
    from marlstone.functions import canonical_code, fold_code

    p = table(spark, d, "part")
    return p.select(canonical_code(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))).alias("canonical"), fold_code((F.lit(75090) + F.col("p_partkey") % 40).cast("string")).alias("folded")).distinct()


@query(f"WITH {PRICES} SELECT city, dept, CAST(date_trunc('quarter', mutation_date) AS DATE) AS period, unit_type, rooms, surface, round(price / surface, 6) AS price_sqm FROM prices WHERE {MANY}")
def p05_p24_observations(spark, d):
    return _rounded(S.observations(S.mutation_prices(units(spark, d), ("region",))), "price_sqm")


@query(f"WITH {PRICES} SELECT mutation_id, unit_type, rooms FROM prices WHERE {ONE}")
def p06_one_kind(spark, d):
    return S.mutation_prices(units(spark, d), ("region",)).where(S.one_kind()).select("mutation_id", "unit_type", "rooms")


@query(f"WITH {UNITS} SELECT city, year(mutation_date) AS year, round(price / surface, 6) AS price_sqm FROM (SELECT *, count(*) OVER (PARTITION BY mutation_id) AS n FROM units) WHERE n = 1 AND surface > 0")
def p25_w11_single_unit_sales(spark, d):
    return _rounded(S.single_unit_sales(units(spark, d)), "price_sqm")


_STAGE = """WITH raw AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id_mutation, l_linenumber, CASE o_orderstatus WHEN 'P' THEN 'Echange' ELSE 'Vente' END AS nature, o_totalprice AS price, l_quantity AS surface, CAST(l_partkey % 5 AS INTEGER) AS kind, CASE WHEN l_suppkey % 7 <> 0 THEN l_returnflag END AS street, CAST(l_linenumber AS VARCHAR) AS no, lpad(CAST(75090 + l_suppkey % 50 AS VARCHAR), 5, '0') AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT id_mutation AS mutation_id, round(price, 6) AS price, surface, CASE WHEN street IS NOT NULL THEN no || ' ' || street END AS address, CASE kind WHEN 1 THEN 'HOUSE' WHEN 2 THEN 'APARTMENT' ELSE 'COMMERCIAL' END AS property_type,
CASE WHEN CAST(code AS INTEGER) BETWEEN 75101 AND 75120 THEN '75056' ELSE code END AS city, count(*) OVER (PARTITION BY id_mutation) AS lots_in_mutation FROM raw WHERE nature = 'Vente' AND kind IN (1, 2, 4) AND price BETWEEN 1000 AND 500000000 AND surface BETWEEN 5 AND 50000"""


@query(_STAGE)
def p07_p12_s02_staged_sales(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    none = F.lit(None).cast("string")
    raw = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("id_mutation"), F.lit("2020-01-01").alias("date_mutation"), F.when(F.col("o_orderstatus") == "P", "Echange").otherwise("Vente").alias("nature_mutation"), F.col("o_totalprice").cast("string").alias("valeur_fonciere"),
        F.col("l_linenumber").cast("string").alias("adresse_numero"), none.alias("adresse_suffixe"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_returnflag")).alias("adresse_nom_voie"), none.alias("code_postal"), F.lpad((F.lit(75090) + F.col("l_suppkey") % 50).cast("string"), 5, "0").alias("code_commune"),
        (F.col("l_partkey") % 5).cast("string").alias("code_type_local"), F.col("l_quantity").cast("string").alias("surface_reelle_bati"), none.alias("longitude"), none.alias("latitude"),
    )
    return S.staged_sales(raw).select("mutation_id", F.round("price", 6).alias("price"), "surface", "address", "property_type", "city", "lots_in_mutation")


@query(f"WITH {UNITS} SELECT region, dept, count(*) AS n FROM units GROUP BY ALL")
def j02_region_rollup(spark, d):
    depts = table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("dept"), F.col("n_regionkey").cast("string").alias("region"))
    return S.with_regions(units(spark, d).drop("region"), depts).groupBy("region", "dept").agg(F.count("*").alias("n"))


@query("SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS city, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS house_share, round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END), 6) AS commercial_share, round(avg(CASE WHEN lots > 1 THEN 1.0 ELSE 0.0 END), 6) AS bloc_share, round(avg(surface), 6) AS mean_surface FROM (SELECT l_orderkey, count(*) AS lots, sum(l_quantity) AS surface FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def a32_sales_mix_full(spark, d):
    lots = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lots"), F.sum("l_quantity").alias("surface"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = lots.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("city"), "o_orderstatus", "lots", "surface")
    return _rounded(S.sales_mix(rows, "city", "o_orderstatus", "surface", "F", "P"), "house_share", "commercial_share", "bloc_share", "mean_surface")


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal > 5000 DESC, c_custkey) AS nth FROM customer) WHERE nth = 1")
def j04_preferred_entity(spark, d):
    c = table(spark, d, "customer")
    return W.first_of(c, ["c_mktsegment", "c_nationkey"], [(F.col("c_acctbal") > 5000).desc(), F.col("c_custkey")]).select("c_mktsegment", "c_custkey", "c_acctbal")


@query(f"WITH {CLEAN} SELECT serie, geo, period, value FROM clean")
def w10_last_written(spark, d):
    return W.keep_latest(points(spark, d), ["serie", "geo", "period"], tie="event_id").select("serie", "geo", "period", "value")


def _clean(spark, d) -> DataFrame:
    return W.keep_latest(points(spark, d), ["serie", "geo", "period"], tie="event_id")


def _serie(spark, d, name: str) -> DataFrame:
    return _clean(spark, d).where(F.col("serie") == name)


@query(f"WITH {CLEAN} SELECT geo, max_by(value, period) FILTER (serie = 'click') AS click, max_by(value, period) FILTER (serie = 'view') AS view FROM clean GROUP BY geo")
def w01_latest_wide(spark, d):
    # Places without either serie are in, with nulls.
    c = _clean(spark, d)
    return W.latest_wide(c, ["click", "view"]).select("geo", "click", "view")


_BACK = f"WITH {CLEAN}, back AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS b FROM clean WHERE serie = 'view') "


@query(_BACK + "SELECT geo, round(avg(value), 6) AS value FROM back WHERE b <= 4 GROUP BY geo")
def w02_mean_of_last(spark, d):
    return _rounded(W.mean_of_last(_serie(spark, d, "view")), "value")


@query(_BACK + "SELECT geo, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS value FROM back WHERE b <= 4 GROUP BY geo")
def w03_sum_of_last(spark, d):
    return W.sum_of_last(_serie(spark, d, "view").withColumn("value", F.round(F.col("value") * 100).cast("long")))


@query(f"""WITH {CLEAN}, b AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS k FROM clean WHERE serie = 'view'),
g AS (SELECT geo, max(value) FILTER (k = 1) AS last, max(value) FILTER (k = 2) AS before, max(value) FILTER (k = 13) AS base, avg(value) FILTER (k <= 4) AS avg4 FROM b WHERE k <= 13 GROUP BY geo),
p AS (SELECT geo, round_even(last, 2) AS median_price_per_sqm, round(CASE WHEN base > 0 THEN (last / base - 1) * 100 END, 2) AS growth, CASE WHEN before IS NULL THEN 'stable' WHEN before <> 0 AND (last - before) / before > 0.02 THEN 'up' WHEN before <> 0 AND (last - before) / before < -0.02 THEN 'down' ELSE 'stable' END AS price_trend FROM g),
v AS (SELECT geo, CAST(sum(value) AS BIGINT) AS transaction_volume FROM (SELECT geo, period, CAST(round(value) AS BIGINT) AS value, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS k FROM clean WHERE serie = 'click') WHERE k <= 4 GROUP BY geo)
SELECT geo, median_price_per_sqm, growth AS price_growth_3y, price_trend, transaction_volume FROM p FULL JOIN v USING (geo)""")
def w04_w05_j10_snapshot(spark, d):
    v = _serie(spark, d, "click").withColumn("value", F.round("value").cast("long"))
    return W.snapshot(_serie(spark, d, "view"), v).drop("sparkline", "avg_price_per_sqm")


@query(f"""WITH {CLEAN}, b AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS k FROM clean WHERE serie = 'view')
SELECT geo, '[' || string_agg(CAST(round_even(value, 0) AS VARCHAR), ',' ORDER BY period) || ']' AS sparkline FROM b WHERE k <= 8 GROUP BY geo""")
def w06_f10_sparkline(spark, d):
    s = _serie(spark, d, "view")
    return W.snapshot(s, s.limit(0)).select("geo", "sparkline")


@query(f"WITH {SALES}, y AS (SELECT city AS geo, year, count(*)::DOUBLE AS value FROM sales GROUP BY ALL), m AS (SELECT geo, max(year) AS last FROM y GROUP BY geo) SELECT m.geo, round((a.value / b.value - 1) * 100, 6) AS growth FROM m JOIN y a ON a.geo = m.geo AND a.year = last JOIN y b ON b.geo = m.geo AND b.year = last - 5 WHERE b.value > 0")
def w07_growth_5y(spark, d):
    y = sales(spark, d).groupBy(F.col("city").alias("geo"), "year").agg(F.count("*").cast("double").alias("value"))
    return _rounded(W.growth_over_years(y), "growth")


@query(f"WITH {CLEAN} SELECT geo, period, value AS price, lag(value, 1) OVER w AS price_lag1, lag(value, 2) OVER w AS price_lag2, lag(value, 4) OVER w AS price_lag4 FROM clean WHERE serie = 'view' WINDOW w AS (PARTITION BY geo ORDER BY period)")
def w08_lags(spark, d):
    return W.with_lags(_serie(spark, d, "view").select("geo", "period", F.col("value").alias("price")))


@query(f"WITH {CLEAN} SELECT geo, period, value AS price, lead(value, 1) OVER w AS target_1, lead(value, 4) OVER w AS target_4, lead(period, 1) OVER w AS period_1, lead(period, 4) OVER w AS period_4 FROM clean WHERE serie = 'view' WINDOW w AS (PARTITION BY geo ORDER BY period)")
def w09_targets(spark, d):
    return W.with_targets(_serie(spark, d, "view").select("geo", "period", F.col("value").alias("price")), (1, 4))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS nth FROM customer) WHERE nth = 1")
def w12_most_populous(spark, d):
    return W.first_of(table(spark, d, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")]).select("c_nationkey", "c_custkey")


@query(f"WITH {CLEAN} SELECT geo, value FROM (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS nth FROM clean WHERE serie = 'view' AND value IS NOT NULL) WHERE nth = 1")
def w13_latest_complete(spark, d):
    return W.keep_latest(_serie(spark, d, "view").where("value is not null"), ["geo"], "period").select("geo", "value")


@query(f"WITH {CLEAN} SELECT serie, geo, period, round(change, 6) AS change FROM (SELECT *, (value - prev) / prev AS change FROM (SELECT *, lag(value) OVER (PARTITION BY serie, geo ORDER BY period) AS prev FROM clean) WHERE prev >= 5) WHERE abs(change) > 0.5 ORDER BY abs(change) DESC, serie, geo, period LIMIT 40")
def w14_t05_k03_jumps(spark, d):
    return _rounded(W.jumps(_clean(spark, d), 0.5, 5.0).select("serie", "geo", "period", "change"), "change", digits=6)


@query(f"WITH {SALES}, c AS (SELECT dept, price, surface, sum(surface) OVER (PARTITION BY dept ORDER BY price RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(surface) OVER (PARTITION BY dept) AS total FROM sales) SELECT dept, min(price) AS weighted_median FROM c WHERE cum >= total / 2 GROUP BY dept")
def w17_weighted_median(spark, d):
    return W.weighted_median(sales(spark, d), ["dept"], "price", "surface")


_OBS = f"{SALES}, obs AS (SELECT city, dept, year, price / surface AS price_sqm FROM sales)"


@query(f"WITH {_OBS}, m AS (SELECT dept, year, quantile_cont(price_sqm, 0.5) AS m FROM obs GROUP BY ALL), r AS (SELECT dept, m AS ref FROM m WHERE year = (SELECT max(year) FROM obs)) SELECT city, dept, year, round(price_sqm * coalesce(ref / m, 1.0), 6) AS adj FROM obs JOIN m USING (dept, year) LEFT JOIN r USING (dept)")
def g05_time_adjusted(spark, d):
    obs = sales(spark, d).select("city", "dept", "year", (F.col("price") / F.col("surface")).alias("price_sqm"))
    return _rounded(W.time_adjusted(obs).select("city", "dept", "year", "adj"), "adj")


@query(f"""WITH {CITIES}, p AS (SELECT a.id AS target, b.id AS point, {haversine('a', 'b')} AS km, b.population / 1000 AS n FROM cities a JOIN cities b ON a.dept = b.dept), r AS (SELECT target, point, n, sum(n) OVER (PARTITION BY target ORDER BY km, point ROWS UNBOUNDED PRECEDING) AS cum FROM p WHERE km <= 25)
SELECT target, point, CAST(cum AS BIGINT) AS cum FROM r WHERE cum - n < 30""")
def w16_pooled_until(spark, d):
    from marlstone.operators.spatial import near_pairs

    c = cities(spark, d)
    p = near_pairs(c, c, 25.0, block="dept").join(c.select(F.col("id").alias("point"), (F.col("population") / 1000).cast("long").alias("n")), "point")
    return W.pooled_until(p, 30).select("target", "point", "cum")


#: Sales that make a target of a city's own in the queries below: more than the operator's 30, so that the test tables' cities pool.
_OWN = 300


def _pooled(spark, d) -> DataFrame:
    from marlstone.operators.spatial import near_pairs

    s = sales(spark, d).withColumn("adj", F.col("price") / F.col("surface"))
    c = cities(spark, d)
    return W.pooled_targets(s.select("city", "adj"), c.select(F.col("id").alias("city")), near_pairs(c, c, 25.0, block="dept"), own=_OWN)


_OWN_SQL = f"WITH {SALES}, o AS (SELECT city, count(*) AS n_own FROM sales GROUP BY city), {CITIES} SELECT id AS city, coalesce(n_own, 0) AS n_own, coalesce(n_own, 0) >= {_OWN} AS own FROM cities LEFT JOIN o ON o.city = id"


def _own_counts(pooled: DataFrame) -> DataFrame:
    return pooled.select("city", "n_own", F.coalesce(F.col("reliability") == "own", F.lit(False)).alias("own"))


@query(_OWN_SQL)
def g06_pooled_own_counts(spark, d):
    return _own_counts(_pooled(spark, d))


@query(f"""WITH {SALES}, {CITIES}, s AS (SELECT city, price / surface AS adj FROM sales), own AS (SELECT city, count(*) AS n_own, quantile_cont(adj, 0.5) AS own_price FROM s GROUP BY city),
near AS (SELECT a.id AS target, b.id AS point, {haversine('a', 'b')} AS km, o.n_own AS n FROM cities a LEFT JOIN own m ON m.city = a.id JOIN cities b ON a.dept = b.dept JOIN own o ON o.city = b.id WHERE coalesce(m.n_own, 0) < {_OWN} AND {haversine('a', 'b')} <= 25),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY target ORDER BY km, point ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY target ORDER BY km, point) AS nth FROM near), taken AS (SELECT * FROM ranked WHERE cum - n < {_OWN} AND nth <= 60),
reach AS (SELECT target, sum(n) AS n_pooled, max(km) AS radius FROM taken GROUP BY target), each AS (SELECT target, adj, 1 / (1 + km / 10.0::DOUBLE) AS w FROM taken JOIN s ON s.city = point),
med AS (SELECT target, min(adj) AS pooled FROM (SELECT target, adj, sum(w) OVER (PARTITION BY target ORDER BY adj RANGE UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY target) AS every FROM each) WHERE cum >= every / 2 GROUP BY target),
kinds AS (SELECT id AS city, coalesce(n_own, 0) AS n_own, coalesce(n_pooled, n_own, 0) AS n_pooled, coalesce(radius, 0) AS radius, own_price, pooled, CASE WHEN n_own >= {_OWN} THEN 'own' WHEN n_pooled >= {_OWN} THEN 'pooled' WHEN n_pooled IS NOT NULL AND n_own >= 10 THEN 'own_thin' END AS reliability FROM cities LEFT JOIN own ON own.city = id LEFT JOIN reach ON reach.target = id LEFT JOIN med ON med.target = id)
SELECT city, n_own, CAST(n_pooled AS BIGINT) AS n_pooled, round(radius, 6) AS radius_km, round(CASE WHEN reliability IN ('own', 'own_thin') THEN own_price WHEN reliability = 'pooled' THEN pooled END, 6) AS target, reliability FROM kinds""")
def g06_pooled_targets(spark, d):
    return _rounded(_pooled(spark, d), "radius_km", "target")


@query(f"WITH {CITIES}, m AS (SELECT dept, quantile_cont(price, 0.5) AS g FROM cities GROUP BY dept), a AS (SELECT quantile_cont(price, 0.5) AS a FROM cities) SELECT id, round(coalesce(price, g, a), 6) AS price, price IS NULL AS price_missing FROM cities LEFT JOIN m USING (dept), a")
def g07_a33_group_fill(spark, d):
    return _rounded(W.group_fill(cities(spark, d), ["price"]).select("id", "price", "price_missing"), "price")


@query(f"""WITH {CLEAN}, b AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY period DESC) AS k FROM clean WHERE serie = 'view'), l AS (SELECT geo, value AS last FROM b WHERE k = 1), m AS (SELECT quantile_cont(last, 0.5) AS med FROM l)
SELECT geo, round_even(last, 2) AS median_price_per_sqm FROM l, m WHERE last <= 3 * med""")
def g08_outliers_withheld(spark, d):
    s = _serie(spark, d, "view")
    last = W.latest(s)
    med = last.select("geo").crossJoin(F.broadcast(last.agg(F.percentile("value", F.lit(0.5)).alias("median"))))
    return W.snapshot(s, s.limit(0), med).select("geo", "median_price_per_sqm")


@query(f"WITH {POINTS} SELECT serie, geo, count(*) AS n FROM points GROUP BY ALL HAVING count(*) > 1")
def k09_duplicates(spark, d):
    from marlstone.operators.quality import duplicates

    return duplicates(points(spark, d), ["serie", "geo"])


@query(f"WITH {UNITS} SELECT DISTINCT mutation_id, city, surface, unit_type FROM units")
def p11_distinct_rows(spark, d):
    return S.distinct_units(units(spark, d), ("mutation_id", "city", "surface", "unit_type"))


@query(f"WITH {PRICES} SELECT geo_code, CAST(date_trunc('quarter', mutation_date) AS DATE) AS period, round(quantile_cont(price / surface, 0.5), 6) AS value FROM (SELECT *, 'FR' AS geo_code FROM prices) WHERE {MANY} GROUP BY ALL HAVING count(DISTINCT mutation_id) >= 3 ORDER BY geo_code, period")
def t01_a38_national_quarters(spark, d):
    p = S.at_levels(S.mutation_prices(units(spark, d), ("region",)), {})
    return _rounded(S.price_series(p, 3).select("geo_code", "period", "value"), "value").orderBy("geo_code", "period")


@query(f"WITH {PRICES} SELECT unit_type, {_SIZE} AS size_class, CAST(date_trunc('quarter', mutation_date) AS DATE) AS period, round(quantile_cont(price / surface, 0.5), 6) AS value FROM prices WHERE {ONE} GROUP BY ALL HAVING count(*) >= 3")
def a38_by_type_and_rooms(spark, d):
    return _rounded(S.national_by_type(S.mutation_prices(units(spark, d), ("region",))), "value")


@query(f"WITH {CLEAN} SELECT p.geo, p.period, p.value AS price, v.value AS volume FROM (SELECT * FROM clean WHERE serie = 'view') p FULL JOIN (SELECT * FROM clean WHERE serie = 'click') v ON p.geo = v.geo AND p.period = v.period".replace("SELECT p.geo, p.period", "SELECT coalesce(p.geo, v.geo) AS geo, coalesce(p.period, v.period) AS period"))
def j11_panel(spark, d):
    a = _serie(spark, d, "view").select("geo", "period", F.col("value").alias("price"))
    return S.panel(a, _serie(spark, d, "click").select("geo", "period", F.col("value").alias("volume")))


@query(f"WITH {SALES} SELECT count(*) AS n FROM sales WHERE mutation_date > (SELECT max(mutation_date) - INTERVAL 12 MONTH FROM sales)")
def j08_scalar_window(spark, d):
    return S.since_latest(sales(spark, d)).agg(F.count("*").alias("n"))


@query(f"WITH {UNITS}, t AS (SELECT mutation_id, count(*) AS all_units FROM units GROUP BY 1) SELECT all_units, count(*) AS n FROM units JOIN t USING (mutation_id) GROUP BY 1")
def j03_totals_back(spark, d):
    return S.with_mutation_units(units(spark, d)).groupBy("all_units").agg(F.count("*").alias("n"))


@query(f"WITH {UNITS} SELECT geo_level, geo_code, CAST(date_trunc('quarter', mutation_date) AS DATE) AS period, max(surface) AS value, count(DISTINCT mutation_id) AS n_sales FROM {levels('units')} WHERE nature = 'F' GROUP BY ALL HAVING count(DISTINCT mutation_id) >= 4")
def a01_generic_serie(spark, d):
    return S.series(S.at_levels(units(spark, d).where("nature = 'F'")), F.max("surface"), 4)


@query(f"WITH {UNITS} SELECT unit_type, rooms, {_SIZE} AS size_class, CASE unit_type WHEN 1 THEN 'HOUSE' ELSE 'APARTMENT' END AS property_type, count(*) AS n FROM units GROUP BY ALL")
def p08_p09_types(spark, d):
    kinds = F.create_map(*[x for k, v in S.UNIT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return units(spark, d).groupBy("unit_type", "rooms", S.typology(F.col("rooms")).alias("size_class"), kinds[F.col("unit_type")].alias("property_type")).agg(F.count("*").alias("n"))


QUERIES["g06_pooled_own_counts_all"], SQL["g06_pooled_own_counts_all"] = QUERIES["g06_pooled_own_counts"], SQL["g06_pooled_own_counts"]  # a second name of the same query
