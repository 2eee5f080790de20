"""Side-by-side k-means and the mixture against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from marlstone.operators import clusters as C
from marlstone.operators import models as M


def _frame(spark, x, **columns):
    names = list(columns)
    rows = [(i, [float(v) for v in r], *(columns[n][i] for n in names)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "a", *names]).repartition(5)
    return df.withColumn("scaled", array_to_vector("a"))


def _lloyd(x, c):
    """Plain Lloyd steps from centres c until they stay; the cost."""
    for _ in range(100):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        of = d.argmin(axis=1)
        new = np.array([x[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        if ((new - c) ** 2).sum() <= 1e-12:
            break
        c = new
    return d.min(axis=1).sum()


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    return np.concatenate([rng.normal(size=(150, 3)) + 6 * np.eye(3)[k] for k in range(3)])


def test_groups_cost_what_plain_steps_cost(spark, points):
    """Each group's best start has the cost of a plain version from the same starts; a small group and a null one have their own rules."""
    group = ["a" if k % 3 else "b" for k in range(440)] + ["tiny"] * 6 + [None] * 4
    df = _frame(spark, points, g=group)
    fits = C.kmeans_fits(df, [2, 4], 3, "g", least=5)
    assert {(f.group, f.k) for f in fits} == {(g, k) for g in ("a", "b", "tiny") for k in (2, 4)}
    for f in fits:
        x = points[[g == f.group for g in group]]
        sample = C._starting(df.where(f"g = '{f.group}'").selectExpr("0 as g", "a as x"))[0]
        want = min(_lloyd(x, C.spread(sample, f.k, np.random.default_rng([C.SEED, s, f.k]))) for s in range(3))
        assert f.cost == pytest.approx(want, rel=1e-9)
    got = {r["id"]: r["cluster"] for r in C.split_clusters(df, "g", least=100, starts=3).collect()}
    assert {got[i] for i in range(440, 446)} == {"tiny"} and {got[i] for i in range(446, 450)} == {""}
    assert {v[:2] for i, v in got.items() if i < 440} == {"a_", "b_"} and len(set(got.values())) == 6


def test_scan(spark, points):
    """The cost falls with k, three clear groups have the best silhouette, and it is that of all pairs."""
    df = _frame(spark, points)
    scan = {k: (cost, s) for k, cost, s in M.scan_k(df, [2, 3, 4, 5], starts=4)}
    costs = [scan[k][0] for k in (2, 3, 4, 5)]
    assert costs == sorted(costs, reverse=True) and max(scan, key=lambda k: scan[k][1]) == 3
    f = M.best_kmeans(df, 3)
    of = C.distances(points, f.centres).argmin(axis=1)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(points)):
        means = [d[i, of == j].sum() / ((of == j).sum() - (j == of[i])) for j in range(3)]
        a, b = means[of[i]], min(m for j, m in enumerate(means) if j != of[i])
        s.append((b - a) / max(a, b))
    assert C.silhouettes(df, [f])[3] == pytest.approx(np.mean(s))
    near = M.representatives(df, f, n=4).collect()
    assert len(near) == 12 and all(r["distance"] == pytest.approx(((points[r["id"]] - f.centres[r["prediction"]]) ** 2).sum()) for r in near)


@pytest.mark.parametrize("seed", [1, 2, 3, 42, 47])
def test_mixture_finds_its_optimum(spark, seed):
    """Three long, crossing groups: whatever the seed, the likelihood reaches that of the true memberships' mixture."""
    rng = np.random.default_rng(3)
    truth = np.arange(600) % 3
    x = rng.normal(size=(600, 6)) * np.where(truth[:, None] == 0, 0.5, 1.0)
    x[:, 4] += 9 * (truth == 1)
    x[:, 5] += 9 * (truth == 2)
    m = C.mixture(_frame(spark, x), 3, seed=seed, starts=5)
    p = np.eye(3)[truth]
    for _ in range(50):
        sums = np.zeros((3, 7, 7))
        for j in range(3):
            w = x * p[:, j : j + 1]
            sums[j, :-1, :-1], sums[j, :-1, -1], sums[j, -1, 0] = w.T @ x, w.sum(axis=0), p[:, j].sum()
        best = C._mixture_of(sums, 1e-6)
        p, logs = best.memberships(x)
    assert m.likelihood == pytest.approx(logs.mean(), abs=1e-3)
    assert m.memberships(x)[1].mean() == pytest.approx(m.likelihood, abs=1e-6)


def test_exact_sample(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as v")
    one = {r["id"] for r in M.bounded_sample(df.repartition(9), "id", 137).collect()}
    assert len(one) == 137 and one == {r["id"] for r in M.bounded_sample(df.coalesce(1), "id", 137).collect()}
    assert M.bounded_sample(df, "id", 5000).count() == 1000 and M.bounded_sample(df, "v", 20).count() == 20
    assert abs(sum(one) / 137 - 500) < 100 and not math.isnan(sum(one))
