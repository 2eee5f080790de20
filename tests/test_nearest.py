"""Unbounded nearest search against all distances."""

import numpy as np
import pytest

from marlstone.operators import nearest as N


def _km(a, b):
    lat, lon = np.radians(a[:, None]), np.radians(b[None])
    d = np.sin((lon[..., 0] - lat[..., 0]) / 2) ** 2 + np.cos(lat[..., 0]) * np.cos(lon[..., 0]) * np.sin((lon[..., 1] - lat[..., 1]) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(d)))


def _check(spark, targets, points, kinds, k, leaf):
    t = spark.createDataFrame([(f"t{i}", float(a), float(b)) for i, (a, b) in enumerate(targets)], "id string, lat double, lon double")
    p = spark.createDataFrame([(i, float(a), float(b), g, 0.0) for i, ((a, b), g) in enumerate(zip(points, kinds, strict=True))], "id int, lat double, lon double, category string, km double")
    got = {}
    for r in sorted(N.nearest(t, p, k, "category", leaf=leaf).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["target"], r["category"]), []).append((r["km"], r["point"]))
    km = _km(targets, points)
    for i in range(len(targets)):
        for g in set(kinds):
            own = [j for j, x in enumerate(kinds) if x == g]
            want = sorted((km[i, j], j) for j in own)[:k]
            mine = got[f"t{i}", g]
            assert [x for x, _ in mine] == pytest.approx([x for x, _ in want], abs=1e-6) and len({j for _, j in mine}) == len(want)
    assert len(got) == len(targets) * len(set(kinds))


def test_far_points_and_a_hot_town(spark):
    """A third of all points in one town, some on one spot, a category with a single point beyond any limit, the date line, a pole."""
    rng = np.random.default_rng(9)
    town = np.array([48.85, 2.35]) + rng.normal(size=(700, 2)) * 1e-3
    spot = np.tile([48.8501, 2.3501], (150, 1))
    wide = np.column_stack([rng.uniform(-90, 90, 600), rng.uniform(-180, 180, 600)])
    points = np.concatenate([town, spot, wide, [[-50.0, 179.99], [89.99, 10.0]]])
    kinds = ["a" if j % 3 else "b" for j in range(len(points))]
    kinds[-2], kinds[-1] = "one", "b"
    targets = np.array([[48.85, 2.35], [48.8501, 2.3501], [46.0, 3.0], [-50.0, -179.99], [89.9, -170.0], [-89.9, 0.0], [0.0, 0.0], [12.0, 130.0]])
    _check(spark, targets, points, kinds, 4, 16)
    p = spark.createDataFrame([(i, float(a), float(b), 0) for i, (a, b) in enumerate(points)], "point int, plat double, plon double, category int").withColumns(N._on_sphere(N.F.col("plat"), N.F.col("plon")))
    leaves = [r for d in N._tree(p.where("point < 700"), 16) for r in d.where("items is not null").select("n", N.F.size("items").alias("held")).collect()]
    assert sum(r["held"] for r in leaves) == 700 and max(r["held"] for r in leaves) <= 400 and len(leaves) > 4


def test_own_neighbours_and_odd_rows(spark):
    """A target isn't its own neighbour, doubles of a place are; null coordinates, null categories and empty tables take no part."""
    rows = [(1, 45.0, 3.0, "x"), (2, 45.0, 3.0, "x"), (3, 45.1, 3.0, None), (4, None, 3.0, "x"), (5, 46.0, 3.0, "x")]
    df = spark.createDataFrame(rows, "id int, lat double, lon double, category string")
    got = {(r["target"], r["rank"]): r["point"] for r in N.nearest(df, df, 2, same=True).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2, (5, 1): 3, (5, 2): 1}
    per = {(r["target"], r["category"]) for r in N.nearest_per_category(df, df).collect()}
    assert per == {(k, "x") for k in (1, 2, 3, 5)}
    assert N.nearest(df, df.limit(0)).count() == 0 and N.nearest(df.limit(0), df).count() == 0


def test_many_categories(spark):
    targets = spark.createDataFrame([("a", 45.0, 3.0), ("b", 45.1, 3.1)], "id string, lat double, lon double")
    points = spark.range(2600).selectExpr("id", "45.0D + (id % 50) * 0.001D as lat", "3.0D + (id % 37) * 0.001D as lon", "cast(id % 1300 as string) as category")
    assert N.nearest_per_category(targets, points).count() == 2600
