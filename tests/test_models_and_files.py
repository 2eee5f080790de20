"""Model reports, and files written and read."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import models as M
from marlstone.operators import sales
from marlstone.sources import readers, sinks


def test_importances_and_ablation(spark):
    """The label hangs on one feature only: it has the importance, and the errors fall once it is in."""
    rows = spark.range(1200).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("c")).withColumn("y", 10 * F.col("b"))
    rows = M.split_by_hash(rows, "id").cache()
    imp = {r["feature"]: r["importance"] for r in M.importances(M.boosted(rows, "y", ["c"], ["a", "b"], iterations=5), rows).collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and imp["b"] > 0.9 and any(k.startswith("c") for k in imp)
    got = {r["level"]: r for r in M.ablation(rows, "y", {0: ("a",), 1: ("b",)}, iterations=5).collect()}
    assert [got[k]["features"] for k in (0, 1)] == [1, 2] and got[1]["mae"] < 0.5 * got[0]["mae"]
    assert M.features_up_to(0) == list(M.FEATURE_LEVELS[0]) and len(M.features_up_to(3)) == sum(map(len, M.FEATURE_LEVELS.values()))


def test_intervals_hold_what_they_say(spark):
    """Eight of ten test errors lie within the margin; growth and interval follow from the forecast."""
    panel = spark.range(600).select((F.col("id") % 20).alias("geo"), F.floor(F.col("id") / 20).cast("int").alias("t"), (100 + 10 * F.rand(3)).alias("price"))
    panel = panel.withColumn("period", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t"))).withColumns({"target_1": F.col("price") + F.randn(4), "period_1": F.date_add("period", 1)}).cache()
    first = F.to_date(F.lit("2024-01-20"))
    fitted = M.horizon_models(panel, (1,), ["price"], first, iterations=5)
    report = M.horizon_report(fitted, panel, first)
    r = report.first()
    test = fitted[1].transform(panel.where(F.col("period_1") >= first)).select(F.abs(F.col("target_1") - F.col("prediction")).alias("e")).collect()
    within = sum(x["e"] <= r["margin"] for x in test)
    assert r["n"] == len(test) and r["mae"] == pytest.approx(sum(x["e"] for x in test) / len(test)) and 0.79 <= within / len(test) <= 0.82
    base = [abs(x["target_1"] - x["price"]) for x in panel.where(F.col("period_1") >= first).collect()]
    assert r["baseline_mae"] == pytest.approx(sum(base) / len(base)) and r["better"] == ("model" if r["mae"] < r["baseline_mae"] else "baseline")
    f = M.forecast_ranges(fitted, panel.where("t = 29"), report).collect()
    assert len(f) == 20 and all(x["high_1"] - x["low_1"] == pytest.approx(2 * r["margin"]) and x["growth_1"] == pytest.approx((x["forecast_1"] / x["price"] - 1) * 100) for x in f)


def test_points_inside(spark, tmp_path):
    """A horseshoe, whose mean of vertices lies outside, a ring with a hole, two parts and a polygon without height."""
    shapes = {
        "horseshoe": ("Polygon", [[[0, 0], [10, 0], [10, 10], [8, 10], [8, 1], [2, 1], [2, 10], [0, 10]]]),
        "ring": ("Polygon", [[[0, 0], [9, 0], [9, 9], [0, 9]], [[1, 1], [8, 1], [8, 8], [1, 8]]]),
        "parts": ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 1]]], [[[20, 5], [24, 5], [24, 9], [20, 9]]]]),
    }
    flat = {"type": "Polygon", "coordinates": [[[0, 3], [4, 3]]]}
    features = [{"properties": {"code": k}, "geometry": {"type": t, "coordinates": c}} for k, (t, c) in shapes.items()] + [{"properties": {"code": "flat"}, "geometry": flat}, {"properties": {"code": "none"}, "geometry": None}]
    (tmp_path / "geo.json").write_text(json.dumps({"features": features}))
    p = readers.polygons(spark, str(tmp_path / "geo.json"))
    from marlstone.operators.spatial import inside

    got = {r["code"]: r for r in p.withColumn("ok", inside(F.col("rings"), F.col("lon"), F.col("lat"))).collect()}
    assert got.keys() == {*shapes, "flat"} and all(got[k]["ok"] for k in shapes)
    assert (got["flat"]["lat"], got["flat"]["lon"]) == (3.0, 2.0)


def test_sidecar_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", 5.0, "high", 0.2), ("2", None, "low", None)], "city string, score double, confidence string, part double")
    sinks.write_with_sidecar(rows, str(tmp_path / "s"), "city", ["score"], ["confidence", "part"])
    assert spark.read.parquet(str(tmp_path / "s")).columns == ["city", "score"]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "s_detail")).collect()} == {("1", 5.0, "high", 0.2), ("2", None, "low", None)}


def test_upsert_protects(spark):
    old = spark.createDataFrame([(1, 1.0, "sales", 1), (2, 2.0, "guess", 1)], "id int, value double, origin string, written_at int")
    new = spark.createDataFrame([(1, 9.0, "guess", 2), (2, 8.0, "guess", 2), (3, 7.0, "guess", 2)], old.schema)
    got = sinks.upserted(old, new, ["id"], F.col("origin") == "sales").collect()
    assert {(r["id"], r["value"]) for r in got} == {(1, 1.0), (2, 8.0), (3, 7.0)}


def test_gzipped_sales(spark, tmp_path):
    """Quotes doubled within a field, a repeated row, a price that is none, and a nature that isn't a sale."""
    head = "id_mutation,date_mutation,nature_mutation,valeur_fonciere,adresse_numero,adresse_suffixe,adresse_nom_voie,code_postal,code_commune,code_type_local,surface_reelle_bati,longitude,latitude"
    lines = ['a,2020-05-01,Vente,200000,1,,"RUE ""X"", A",75001,75101,2,40,2.3,48.8'] * 2 + ["b,2020-05-01,Vente,none,1,,R,1,1001,1,40,,", "c,2020-05-01,Echange,200000,1,,R,1,1001,1,40,,", "d,bad,Vente,150000,,,,1,1001,1,50,,"]
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write("\n".join([head, *lines]) + "\n")
    got = {r["mutation_id"]: r for r in sales.staged_sales(readers.sales_geo(spark, str(tmp_path / "*.csv.gz"), 3)).collect()}
    assert got.keys() == {"a", "d"}
    assert (got["a"]["address"], got["a"]["city"], got["a"]["lots_in_mutation"], got["a"]["property_type"]) == ('1 RUE "X", A', "75056", 1, "APARTMENT")
    assert (got["d"]["address"], got["d"]["mutation_date"], got["d"]["city"]) == (None, None, "01001")
