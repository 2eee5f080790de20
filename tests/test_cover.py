"""Points in polygons by rows of cells against the test of all edges."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import spatial as G


def _star(rng, x, y, size, n):
    """A ring with long and short spikes."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = size * rng.uniform(0.3, 1.0, n)
    return [(float(x + a), float(y + b)) for a, b in zip(r * np.cos(angle), r * np.sin(angle), strict=True)]


def test_same_as_all_edges(spark):
    """Stars, holes, squares along cell edges, a region of many cells, one without height, an empty ring; points on cell corners."""
    rng = np.random.default_rng(12)
    shapes = {f"s{k:02d}": [_star(rng, rng.uniform(0, 3), rng.uniform(44, 47), rng.uniform(0.02, 0.6), int(rng.integers(3, 60)))] for k in range(25)}
    shapes["square"] = [[(1.0, 45.0), (1.5, 45.0), (1.5, 45.5), (1.0, 45.5)], [(1.1, 45.1), (1.4, 45.1), (1.4, 45.4), (1.1, 45.4)]]
    shapes["region"] = [_star(rng, 1.5, 45.5, 1.6, 800)]
    shapes["flat"] = [[(0.0, 46.0), (2.0, 46.0)]]
    shapes["empty"] = [[]]
    polygons = spark.createDataFrame([(k, [[{"lon": x, "lat": y} for x, y in r] for r in rings]) for k, rings in shapes.items()], "code string, rings array<array<struct<lon:double,lat:double>>>")
    at = [(float(x), float(y)) for x, y in zip(rng.uniform(-0.5, 3.5, 3000), rng.uniform(43.5, 47.5, 3000), strict=True)] + [(x * 0.05, 44 + y * 0.05) for x in range(0, 60, 3) for y in range(0, 60, 3)] + [(1.0, 45.0), (1.25, 45.0), (1.5, 45.25), (0.5, 46.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "id int, lon double, lat double")
    want = {r["id"]: r["code"] for r in points.join(polygons).where(G.inside(F.col("rings"), F.col("lon"), F.col("lat"))).groupBy("id").agg(F.min("code").alias("code")).collect()}
    for cell in (0.05, 0.31):
        got = {r["point"]: r["code"] for r in G.contained(points, polygons, cell).collect()}
        assert got == want


def test_outlines_are_not_copied(spark):
    """Edges are held about once for each row they pass, however many cells the polygon covers."""
    rng = np.random.default_rng(5)
    ring = [{"lon": x, "lat": y} for x, y in _star(rng, 2.0, 45.0, 2.0, 2000)]
    rows = G.strips(spark.createDataFrame([("a", [ring])], "code string, rings array<array<struct<lon:double,lat:double>>>"))
    held, border, inner = rows.agg(F.sum(F.size("edges")), F.sum(F.size("border")), F.sum(F.size("inner"))).first()
    passed = sum(int(np.floor(max(a["lat"], b["lat"]) / 0.05)) - int(np.floor(min(a["lat"], b["lat"]) / 0.05)) + 1 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    assert held == passed and inner > 200 and border < passed * 3
