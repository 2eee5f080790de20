"""Hand-computed cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import acquisition_cost, annuity, canonical_code, department_hint, fold_code, name_key, parse_decimal, strip_parenthesis
from marlstone.operators import census, models, places, sales, scores, spatial, windows
from marlstone.sources import readers, sinks
from marlstone.streaming import ingest_points


def _units(spark, rows):
    return spark.createDataFrame(rows, "mutation_id string, mutation_date date, nature string, price double, dept string, city string, region string, unit_type int, rooms int, surface double")


D = dt.date(2020, 2, 1)


def test_block_sale_counts_once(spark):
    mixed = [("a", D, "Vente", 900_000.0, "77", "77001", "11", 2, 2, 40.0)] * 2 + [("a", D, "Vente", 900_000.0, "77", "77001", "11", 2, 3, 60.0)]
    alike = [("b", D, "Vente", 360_000.0, "77", "77001", "11", 2, 2, 40.0)] * 3
    units = _units(spark, mixed + alike)
    prices = sales.mutation_prices(units, ("region",))
    got = sales.price_series(sales.at_levels(prices), 1).where("geo_level = 'city'").collect()
    assert [(r["value"], r["n_sales"]) for r in got] == [(3000.0, 1)]
    vol = sales.volume(sales.at_levels(units)).where("geo_level = 'country'").first()
    assert vol["value"] == 2


def test_codes_and_numbers(spark):
    r = spark.range(1).select(
        parse_decimal(F.lit("123456,78")).alias("a"), parse_decimal(F.lit("x")).alias("b"), fold_code(F.lit("75112")).alias("c"), fold_code(F.lit("77288")).alias("d"), canonical_code(F.lit(" 123 ")).alias("e"),
        canonical_code(F.lit("1234567")).alias("f"), fold_code(F.lit("2A004")).alias("g"),
    ).first()
    assert tuple(r) == (123456.78, None, "75056", "77288", "00123", "1234567", "2A004")


def test_names(spark):
    r = spark.range(1).select(name_key(F.lit("L'Haÿ-les-Roses")).alias("a"), name_key(F.lit("Sainte-Œuvre")).alias("b"), strip_parenthesis(F.lit("Sèvres (93)")).alias("c"), department_hint(F.lit("dépt 62")).alias("d"), department_hint(F.lit("1")).alias("e"), department_hint(F.lit("note")).alias("f")).first()
    assert tuple(r) == ("haylesroses", "stoeuvre", "Sèvres", "62", "01", None)


def test_resolution_by_prefix(spark):
    p = spark.createDataFrame([("1", "Saint-Denis", "93", 100), ("2", "Saint-Denis", "974", 200), ("3", "Villeneuve-la-Garenne", "92", 5)], "code string, name string, dept string, population long")
    n = spark.createDataFrame([("St Denis", "93"), ("Saint Denis", None), ("Villeneuve", None), ("Nowhere", None)], "name string, hint string")
    done, rest = places.resolve(n, p)
    assert {(r["name"], r["code"], r["confidence"]) for r in done.collect()} == {("Saint Denis", "2", "low"), ("St Denis", "1", "high"), ("Villeneuve", "3", "low")}
    assert [r["name"] for r in rest.collect()] == ["Nowhere"]


def test_growth_needs_thirteen_points(spark):
    days = [dt.date(2020 + k // 4, 1 + 3 * (k % 4), 1) for k in range(12)]
    pts = spark.createDataFrame([("x", d, 100.0 + k) for k, d in enumerate(days)], "geo string, period date, value double")
    r = windows.snapshot(pts, pts.limit(0)).first()
    assert r["price_growth_3y"] is None and r["price_trend"] == "stable" and json.loads(r["sparkline"]) == [104.0 + k for k in range(8)]


def test_idw(spark):
    k = 1 / spatial.DEGREE_KM
    c = spark.createDataFrame([("t", "01", 0.0, 0.0, None), ("a", "01", k, 0.0, 1000.0), ("b", "01", 2 * k, 0.0, 2000.0), ("c", "01", 40 * k, 0.0, 9.0), ("far", "02", 50.0, 0.0, None), ("own", "02", 60.0, 0.0, 7.0)], "id string, dept string, lat double, lon double, price double")
    got = {r["id"]: (r["price"], r["source"]) for r in spatial.idw_fill(c).collect()}
    assert got["t"][0] == pytest.approx(4000 / 3, rel=1e-6) and got["t"][1] == "estimated"
    assert got["far"] == (7.0, "estimated") and got["a"] == (1000.0, "observed")


def test_polygon_with_hole(spark):
    sq = lambda r: [{"lon": x * r, "lat": y * r} for x, y in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))]
    poly = spark.createDataFrame([("p", [sq(1.0), sq(0.3)])], "code string, rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 0.1), (3, 2.0, 0.0)], "id int, lon double, lat double")
    assert [r["point"] for r in spatial.contained(pts, poly).collect()] == [1]


def test_medians(spark):
    r = spark.range(1).select(census.grouped_median(F.array(F.lit(50.0), F.lit(50.0)), [0, 10], [10, 10]).alias("m"), census.grouped_median(F.array(F.lit(0.0)), [0], [10]).alias("n")).first()
    assert tuple(r) == (10.0, None)
    w = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 1.0), ("g", 10.0, 3.0)], "g string, v double, w double")
    assert windows.weighted_median(w, ["g"], "v", "w").first()["weighted_median"] == 10.0


def test_finance(spark):
    r = spark.range(1).select(annuity(F.lit(100_000.0), F.lit(0.0), F.lit(10)).alias("a"), annuity(F.lit(0.0), F.lit(0.03), F.lit(10)).alias("b"), acquisition_cost(F.lit(1000.0)).alias("c")).first()
    assert r["a"] == pytest.approx(833.333, abs=1e-3) and r["b"] == 0.0 and r["c"] == pytest.approx(1175.0)


def test_conformal_level(spark):
    s = spark.createDataFrame([(0.0, 0.0, float(k)) for k in range(1, 10)], "lo double, hi double, y double")
    r = models.conformal_margin(s, "lo", "hi", "y").first()
    assert r["level"] == pytest.approx(8 / 9) and r["margin"] == pytest.approx(8.111, abs=1e-3)


def test_upsert_twice_is_once(spark, tmp_path):
    schema = "serie string, geo string, period date, value double, written_at timestamp, year int"
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("s", "a", D, 1.0, t, 2020), ("s", "b", D, 2.0, t, 2020)], schema)
    sinks.replace_partitions(old, str(tmp_path / "t"), ["year"])
    new = spark.createDataFrame([("s", "a", D, 9.0, t, 2020), ("s", "c", D, 3.0, t, 2020)], schema)
    new.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        q = ingest_points(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), ["serie", "geo", "period"], "year", str(tmp_path / f"ck{k}"))
        q.awaitTermination()
        assert q.exception() is None
    assert {(r["geo"], r["value"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9.0), ("b", 2.0), ("c", 3.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "sales.txt").write_text("Date mutation|Nature mutation|Valeur fonciere|Code departement|Code commune|No voie|Code voie|Code type local|Surface reelle bati|Nombre pieces principales|Surface terrain\n2020-02-01|Vente|100000,50|75|112|1|A|2|40|2|\n")
    r = sales.clean_sales(readers.sales_raw(spark, str(tmp_path / "*.txt"))).first()
    assert (r["price"], r["city"], r["surface"], r["mutation_date"]) == (100000.5, "75056", 40.0, D)
    (tmp_path / "rp-2020.csv").write_text("COM;P20_POP\n75101;5\n75102;6\n", encoding="utf-8-sig")
    (tmp_path / "rp-2021.csv").write_text("COM;P21_POP\n1;7\n")
    got = readers.census_years(spark, str(tmp_path / "rp-*.csv"), {"POP": "pop"}).groupBy("city", "year").agg(F.sum("pop").alias("p")).collect()
    assert {(x["city"], x["year"], x["p"]) for x in got} == {("75056", 2020, 11.0), ("00001", 2021, 7.0)}
    (tmp_path / "flags.csv").write_text("# note\ninsee_code,rent_control\n1,TRUE\n2,FALSE\n")
    assert [x["city"] for x in readers.curated_flags(spark, str(tmp_path / "flags.csv"), "rent_control").collect()] == ["00001"]
    (tmp_path / "rent.csv").write_bytes("INSEE_C;loypredm2;TYPPRED\n75101;10,5;é\n75102;11,5;x\n".encode("cp1252"))
    assert readers.rents(spark, str(tmp_path / "rent.csv")).first()["rent"] == 11.0
    (tmp_path / "geo.json").write_text(json.dumps({"features": [{"properties": {"code": "1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}}]}))
    p = readers.polygons(spark, str(tmp_path / "geo.json")).first()
    assert (p["code"], p["lat"], p["lon"], len(p["rings"])) == ("1", 1.0, 1.0, 1)
    (tmp_path / "c.json").write_text(json.dumps([{"code": "1", "nom": "A", "departement": {"code": "01", "nom": "D"}, "region": {"code": "84", "nom": "R"}, "population": 5, "centre": {"coordinates": [3.0, 45.0]}, "codesPostaux": ["01000"]}]))
    c = readers.flat_communes(readers.communes(spark, str(tmp_path / "c.json"))).first()
    assert (c["lat"], c["lon"], c["postal_code"]) == (45.0, 3.0, "01000")


def test_short_term_score_caps_flags(spark):
    s = scores.short_term_score(F.lit(1000), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("B2"), F.lit(False))
    assert spark.range(1).select(s.alias("s")).first()["s"]["score"] == 0.0
    s = scores.short_term_score(F.lit(1000), F.lit(60), F.lit(30), F.lit("station"), F.lit("A"), F.lit(True))
    assert spark.range(1).select(s.alias("s")).first()["s"]["score"] == pytest.approx(91.0)


def test_artifacts(spark, tmp_path):
    run = sinks.publish(spark, str(tmp_path), "price", {"scores": spark.range(3)}, {"mae": 1.0})
    assert spark.read.parquet(f"{tmp_path}/price/run_id={run}/scores").count() == 3
    assert json.loads(spark.read.text(f"{tmp_path}/price/latest/metadata").first()["value"])["mae"] == 1.0
    sinks.export_csv(spark.createDataFrame([(1, 1.23456)], "id int, value double"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["value"] == "1.2346"
