"""The domain's tables, derived from the driver's: sales from orders and their lines, places from nations and segments, series from events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(n: str, width: int):
    return F.lpad(F.col(n).cast("string"), width, "0")


def _city():
    return F.concat(_code("c_nationkey", 2), F.lpad(F.ascii("c_mktsegment").cast("string"), 3, "0"))


def units(spark: SparkSession, d: str) -> DataFrame:
    """Unit rows of sales, with the sale's total price on each."""
    line, order, cust, nat = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    day = F.to_date("o_orderdate")
    rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nat), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.md5(F.concat_ws("|", day.cast("string"), F.col("o_orderkey").cast("string"))).alias("mutation_id"), day.alias("mutation_date"), F.col("o_orderstatus").alias("nature"), F.col("o_totalprice").alias("price"),
        _code("c_nationkey", 2).alias("dept"), _city().alias("city"), F.col("n_regionkey").cast("string").alias("region"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("unit_type"),
        (F.col("l_partkey") % 6).cast("int").alias("rooms"), F.col("l_quantity").alias("surface"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 10).alias("land"),
    )


UNITS = """units AS (
  SELECT md5(concat_ws('|', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CAST(o_orderkey AS VARCHAR))) AS mutation_id, CAST(o_orderdate AS DATE) AS mutation_date, o_orderstatus AS nature, o_totalprice AS price,
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS dept, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(ascii(c_mktsegment) AS VARCHAR), 3, '0') AS city, CAST(n_regionkey AS VARCHAR) AS region,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS unit_type, CAST(l_partkey % 6 AS INTEGER) AS rooms, l_quantity AS surface, CASE WHEN l_returnflag = 'R' THEN l_quantity * 10 END AS land
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
PRICES = (
    UNITS
    + """, raw AS (SELECT * FROM units WHERE unit_type IN (1, 2) AND surface > 0),
totals AS (SELECT mutation_id, count(*) AS all_units, count(DISTINCT unit_type) AS n_types FROM raw GROUP BY 1),
prices AS (SELECT g.*, all_units, n_types FROM (SELECT mutation_id, mutation_date, nature, dept, city, region, unit_type, rooms, max(price) AS price, sum(surface) AS surface, count(*) AS n_units FROM raw GROUP BY ALL) g JOIN totals USING (mutation_id))"""
)
MANY = "n_types = 1 AND all_units = n_units AND surface BETWEEN 9 AND 2000 AND price > 0 AND price / surface BETWEEN 500 AND 30000"
ONE = "all_units = n_units AND surface BETWEEN 9 AND 500 AND price > 0 AND price / surface BETWEEN 500 AND 30000"
#: The four levels of a relation x.
LEVELS = "(SELECT *, 'city' AS geo_level, city AS geo_code FROM {x} UNION ALL SELECT *, 'department', dept FROM {x} UNION ALL SELECT *, 'region', region FROM {x} UNION ALL SELECT *, 'country', 'FR' FROM {x})"


def levels(x: str) -> str:
    return LEVELS.format(x=x)


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales as one row: order date, price, city and a surface."""
    order, cust = table(spark, d, "orders"), table(spark, d, "customer")
    return order.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("mutation_date"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"), ((F.col("o_orderkey") % 90) + 20).cast("double").alias("surface"), _code("c_nationkey", 2).alias("dept"), _city().alias("city"))


SALES = """sales AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS mutation_date, year(o_orderdate) AS year, o_totalprice AS price, CAST((o_orderkey % 90) + 20 AS DOUBLE) AS surface,
  lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS dept, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(ascii(c_mktsegment) AS VARCHAR), 3, '0') AS city FROM orders JOIN customer ON o_custkey = c_custkey)"""


def cities(spark: SparkSession, d: str) -> DataFrame:
    """Places with coordinates, population, a price known for some, and a few rates."""
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    seg = F.ascii("c_mktsegment")
    known = (F.col("c_nationkey") + seg) % 3 != 0
    return g.select(
        _city().alias("id"), _code("c_nationkey", 2).alias("dept"), (F.col("n") * 1000).alias("population"), (F.lit(43.0) + ((F.col("c_nationkey") * 7) % 25) * 0.25 + (seg % 7) * 0.03).alias("lat"),
        (F.lit(0.0) + ((F.col("c_nationkey") * 3) % 25) * 0.25 + (seg % 5) * 0.04).alias("lon"), F.when(known, (F.col("cents") / 100) / F.col("n")).alias("price"),
        F.when(known & (F.col("n") % 2 == 0), F.col("n") * 1.5).alias("rent"), F.when(F.col("n") % 5 != 0, (F.col("n") % 30) * 1.0).alias("tax_rate"), ((F.col("n") % 20) / 100).alias("vacancy"), (F.col("n") % 4).cast("int").alias("zone_no"),
    )


CITIES = """cities AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(ascii(c_mktsegment) AS VARCHAR), 3, '0') AS id, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS dept, n * 1000 AS population,
  43.0::DOUBLE + ((c_nationkey * 7) % 25) * 0.25::DOUBLE + (ascii(c_mktsegment) % 7) * 0.03::DOUBLE AS lat, 0.0::DOUBLE + ((c_nationkey * 3) % 25) * 0.25::DOUBLE + (ascii(c_mktsegment) % 5) * 0.04::DOUBLE AS lon,
  CASE WHEN (c_nationkey + ascii(c_mktsegment)) % 3 <> 0 THEN (cents / 100) / n END AS price, CASE WHEN (c_nationkey + ascii(c_mktsegment)) % 3 <> 0 AND n % 2 = 0 THEN n * 1.5::DOUBLE END AS rent,
  CASE WHEN n % 5 <> 0 THEN (n % 30) * 1.0::DOUBLE END AS tax_rate, (n % 20) / 100 AS vacancy, CAST(n % 4 AS INTEGER) AS zone_no
  FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) AS cents FROM customer GROUP BY ALL))"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Series points: event type as serie, user as place, day as period, the event's time as that of writing."""
    return table(spark, d, "events").select(F.col("event_type").alias("serie"), F.col("user_id").alias("geo"), F.to_date("ts").alias("period"), "value", F.col("ts").alias("written_at"), "event_id")


POINTS = "points AS (SELECT event_type AS serie, user_id AS geo, CAST(ts AS DATE) AS period, value, ts AS written_at, event_id FROM events)"
#: One point for each serie, place and period: the one written last.
CLEAN = POINTS + ", clean AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY serie, geo, period ORDER BY written_at DESC, event_id) AS nth FROM points) WHERE nth = 1)"


def haversine(a: str, b: str) -> str:
    """SQL for the distance of two aliases' lat and lon."""
    return f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
