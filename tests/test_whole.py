"""Queries and operators that must take all of their input."""

import math

import numpy as np
from pyspark.sql import functions as F

from marlstone.plans import place_queries, sales_queries  # noqa: F401  (they register their queries)
from marlstone.plans.standins import QUERIES, cities, sales

SF = "/root/testdata/sf0.001"


def test_targets_are_of_all_sales(spark):
    known = cities(spark, SF).select(F.col("id").alias("city"))
    want = {r["city"]: r["count"] for r in sales(spark, SF).join(known, "city").groupBy("city").count().collect()}
    got = {r["city"]: r["n_own"] for r in QUERIES["g06_pooled_targets"](spark, SF).collect()}
    assert {k: n for k, n in got.items() if n} == want


def test_polygons_are_of_all_places(spark):
    inside = QUERIES["j18_point_in_polygon"](spark, SF).select("code").distinct().collect()
    assert len({r["code"][-3:] for r in inside}) > 1


def _mixture(x, p, rounds=200):
    """Memberships of a Gaussian mixture with full covariances by brute force, from memberships ``p``."""
    for _ in range(rounds):
        logs = []
        for k in range(p.shape[1]):
            w = p[:, k]
            mean = w @ x / w.sum()
            c = x - mean
            cov = (c * w[:, None]).T @ c / w.sum()
            logs.append(math.log(w.mean()) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c)))
        logs = np.array(logs).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    return p


def test_soft_clusters_of_whole_vectors(spark, tmp_path):
    """Three groups that differ in components after the sixth only."""
    rng = np.random.default_rng(3)
    truth = np.arange(900) % 3
    x = rng.normal(size=(900, 12))
    x[:, 8] += 14 * (truth == 1)
    x[:, 11] += 14 * (truth == 2)
    rows = [(i, int(truth[i]), [float(v) for v in r]) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r for r in QUERIES["m05_f11_soft_clusters"](spark, str(tmp_path)).collect()}
    p = _mixture((x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.eye(3)[truth])
    assert len({(got[i]["prediction"], int(k)) for i, k in enumerate(p.argmax(axis=1))}) == 3
    entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1) / math.log(3)
    assert all(abs(got[i]["entropy"] - e) < 0.02 and got[i]["boundary"] == (e > 0.5) for i, e in enumerate(entropy))


def test_pairs_across_the_date_line(spark):
    from marlstone.operators.spatial import near_pairs

    df = spark.createDataFrame([(1, 0.0, 179.95), (2, 0.0, -179.95), (3, 60.0, 179.9), (4, 60.0, -179.9), (5, 10.0, 0.0)], "id int, lat double, lon double")
    for km in (25.0, 500.0):
        got = {(r["target"], r["point"]) for r in near_pairs(df, df, km, same=True).collect()}
        assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_pooling_takes_few_neighbours(spark):
    from marlstone.operators.windows import pooled_until

    pairs = spark.createDataFrame([("a", k, float(k), 1) for k in range(100)], "target string, point int, km double, n int")
    assert pooled_until(pairs, 1000).count() == 60 and pooled_until(pairs, 30).count() == 30


def test_names(spark):
    from marlstone.functions import department_hint, name_key, strip_parenthesis

    names = {"Le Mans": "mans", "L'Haÿ-les-Roses": "haylesroses", "Saint-Étienne": "stetienne", "Sainte Œuvre": "stoeuvre", "Lesparre": "lesparre", "E\u0301pinal": "epinal", "Le-Bois": "lebois", "Les": "les"}
    rows = spark.createDataFrame([(k,) for k in names], "n string").select("n", name_key(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == names
    hints = {"dépt 62": "62", "DEP. 2a": "2A", "7": "07", "07": "07", "972": "972", "96": None, "977": None, "note 62": None, "62 x": None, "": None, "dept62": "62"}
    rows = spark.createDataFrame([(k,) for k in hints], "n string").select("n", department_hint(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == hints
    bare = {"Sèvres (93)": "Sèvres", " A (b) (c) ": "A", "A (b) c": "A (b) c", "A": "A"}
    rows = spark.createDataFrame([(k,) for k in bare], "n string").select("n", strip_parenthesis(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == bare
