"""Many k-means fits, or starts of a Gaussian mixture, side by side.

Each step is one job over the rows: tasks sum what a step needs (counts, sums,
products of components) for all groups, starts and cluster numbers at once,
Spark adds the sums up, and the driver holds the centres alone.  Rows stay
where they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
#: Rows of a group from which starting centres are drawn.
START_ROWS = 500
#: Numbers in the centres of all fits that are stepped at once; more groups follow in further turns.
AT_ONCE = 5_000_000


def hashed_first(rows: DataFrame, keys: list, n: int, salt: str = "sample") -> DataFrame:
    """Exactly n rows (all, if fewer), those of the smallest hash of ``keys``: each task keeps its n smallest and these are merged (T-07)."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(salt)), *keys).limit(n)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _summed(rows: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], keys: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer keys and the summed values of what the tasks emit, as two matrices of a row for each key."""
    k, v = [f"k{i}" for i in range(keys)], [f"v{i}" for i in range(width)]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, value in emit(source):
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in key.T), *(pa.array(x, pa.float64()) for x in value.T)], [*k, *v])

    schema = ", ".join([f"{c} int" for c in k] + [f"{c} double" for c in v])
    t = rows.mapInArrow(batches, schema).groupBy(*k).agg(*[F.sum(c).alias(c) for c in v]).toArrow()
    return np.column_stack([t[c].to_numpy() for c in k]), np.column_stack([t[c].to_numpy() for c in v])


@dataclass
class Fit:
    """Centres of one k-means fit, with the summed squared distances to them."""

    group: object
    k: int
    start: int
    centres: np.ndarray
    cost: float = math.inf

    def column(self, features: str) -> Column:
        """The nearest centre of a vector column, the first of equals."""
        centres = self.centres

        def nearest(x: pd.Series) -> pd.Series:
            m = np.stack(x.to_list()) if len(x) else np.zeros((0, centres.shape[1]))
            return pd.Series(distances(m, centres).argmin(axis=1), dtype="int32")

        return F.pandas_udf(nearest, "int")(vector_to_array(features))

    def distance(self, features: str, cluster: Column) -> Column:
        """Squared distance of a vector column to the centre of ``cluster``."""
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centres])
        return F.aggregate(F.zip_with(vector_to_array(features), F.get(centres, cluster), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0.0)


def spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows far from each other: each is drawn by its squared distance to those before it."""
    chosen = [int(rng.integers(len(x)))]
    near = distances(x, x[chosen]).min(axis=1)
    while len(chosen) < k:
        chosen.append(int(rng.choice(len(x), p=near / near.sum())) if near.sum() > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen].copy()


def _starting(rows: DataFrame) -> dict[int, np.ndarray]:
    """Up to START_ROWS rows of each group, by a hash of their components."""
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("x", F.lit("start")), "x"))
    got: dict[int, list] = {}
    for r in rows.withColumn("_r", rank).where(F.col("_r") <= START_ROWS).select("g", "x").orderBy("g", "_r").collect():
        got.setdefault(r["g"], []).append(r["x"])
    return {g: np.array(x) for g, x in got.items()}


def lloyd(rows: DataFrame, fits: list[Fit], index: list[int], rounds: int = 100) -> None:
    """Lloyd steps of all ``fits`` on ``rows`` (g, x) until their centres stay, in place; ``index`` has the group g of each."""
    alive = list(range(len(fits)))
    moved = {m: fits[m].centres for m in alive}
    for _ in range(rounds):
        centres = [(m, index[m], moved[m]) for m in alive]
        width = centres[0][2].shape[1] + 2

        def emit(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            total = {m: np.zeros((len(c), width)) for m, _, c in centres}
            for batch in source:
                g, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for group in np.unique(g).tolist():
                    mine = [(m, c) for m, h, c in centres if h == group]
                    if not mine:
                        continue
                    part = x[g == group]
                    d, at = distances(part, np.vstack([c for _, c in mine])), 0
                    ones = np.column_stack([part, np.ones(len(part)), np.zeros(len(part))])
                    for m, c in mine:
                        own = d[:, at : at + len(c)]
                        near = own.argmin(axis=1)
                        ones[:, -1] = own[np.arange(len(part)), near]
                        total[m] += (near == np.arange(len(c))[:, None]).astype(float) @ ones
                        at += len(c)
            keys = [(m, j) for m, _, c in centres for j in range(len(c))]
            yield np.array(keys), np.vstack([total[m] for m, _, _ in centres])

        keys, sums = _summed(rows, emit, 2, width)
        cost = dict.fromkeys(alive, 0.0)
        fresh = {m: moved[m].copy() for m in alive}
        for (m, j), s in zip(keys.tolist(), sums, strict=True):
            cost[m] += s[-1]
            if s[-2] > 0:  # a centre without rows stays
                fresh[m][j] = s[:-2] / s[-2]
        for m in alive:
            fits[m].centres, fits[m].cost = moved[m], float(cost[m])
        alive = [m for m in alive if ((fresh[m] - moved[m]) ** 2).sum() > 1e-12]
        moved = fresh
        if not alive:
            return


def kmeans_fits(rows: DataFrame, ks: list[int], starts: int = 10, group: str | None = None, least: int = 1, features: str = "scaled", rounds: int = 100, seed: int = SEED) -> list[Fit]:
    """The best of several starts for each group of at least ``least`` rows (all rows, without ``group``) and each k (M-02, M-06)."""
    x = vector_to_array(features).alias("x")
    if group is None:
        groups, rows = [(None, rows.count())], rows.select(F.lit(0).alias("g"), x)
    else:
        rows = rows.select(F.col(group).cast("string").alias("own"), x)
        groups = [tuple(r) for r in rows.groupBy("own").count().orderBy("own").collect()]  # a row for each group
        number = rows.sparkSession.createDataFrame([(v, k) for k, (v, _) in enumerate(groups)], "name string, g int")
        rows = rows.join(F.broadcast(number), F.col("own").eqNullSafe(F.col("name"))).select("g", "x")
    rows = rows.persist()
    best: dict[tuple[int, int], Fit] = {}
    try:
        sample = _starting(rows)
        wide = next((s.shape[1] for s in sample.values()), 0)
        take = [k for k, (_, n) in enumerate(groups) if n >= max(least, 1)]
        turn = max(1, AT_ONCE // max(1, starts * sum(ks) * wide))
        for a in range(0, len(take), turn):
            fits, index = [], []
            for g in take[a : a + turn]:
                for k in ks:
                    for s in range(starts):
                        fits.append(Fit(groups[g][0], k, s, spread(sample[g], k, np.random.default_rng([seed, s, k]))))
                        index.append(g)
            lloyd(rows, fits, index, rounds)
            for g, f in zip(index, fits, strict=True):
                if (g, f.k) not in best or f.cost < best[g, f.k].cost:
                    best[g, f.k] = f
    finally:
        rows.unpersist()
    return list(best.values())


def split_clusters(rows: DataFrame, group: str, k: int = 2, least: int = 100, features: str = "scaled", seed: int = SEED, starts: int = 10) -> DataFrame:
    """k-means within each group, all groups at once; small groups stay whole (M-06): column cluster."""
    fits = {f.group: f.centres for f in kmeans_fits(rows, [k], starts, group, least, features, seed=seed)}

    def nearest(name: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(name), dtype="object")
        name = name.astype("object").where(name.notna(), None)
        for value in name.unique():
            if value in fits:
                of = np.flatnonzero(name.isna() if value is None else name == value)
                out.iloc[of] = distances(np.stack(x.iloc[of].to_list()), fits[value]).argmin(axis=1).astype(str)
        return out

    name = F.col(group).cast("string")
    return rows.withColumn("cluster", F.concat_ws("_", name, F.pandas_udf(nearest, "string")(name, vector_to_array(features))))


def silhouettes(rows: DataFrame, fits: list[Fit], features: str = "scaled", most: int = 5000) -> dict[int, float]:
    """Mean silhouette of each fit's clusters, by k, on exactly ``most`` rows or all (M-02): sampled rows meet all others of the sample, in tasks."""
    x = vector_to_array(features).alias("x")
    sample = hashed_first(rows.select(x), ["x"], most)
    points = np.array([r["x"] for r in sample.collect()])  # at most ``most``
    labels = {f.k: distances(points, f.centres).argmin(axis=1) for f in fits}
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((points, labels))
    pieces = spark.range(0, len(points), 250).repartition(max(1, -(-len(points) // 250)), "id")

    def emit(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        points, labels = held.value
        out = dict.fromkeys(labels, 0.0)
        for batch in source:
            for a in batch.column(0).to_pylist():
                d = np.sqrt(distances(points[a : a + 250], points))
                for k, of in labels.items():
                    size = np.bincount(of, minlength=k)
                    sums = d @ (of[:, None] == np.arange(k)).astype(float)
                    own, here = of[a : a + 250], np.arange(len(d))
                    inner = sums[here, own] / np.maximum(size[own] - 1, 1)
                    means = np.where(size > 0, sums / np.maximum(size, 1), np.inf)
                    means[here, own] = np.inf
                    outer = means.min(axis=1)
                    s = np.where((size[own] > 1) & np.isfinite(outer), (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
                    out[k] += s.sum()
        yield np.array(list(out))[:, None], np.array(list(out.values()))[:, None]

    keys, sums = _summed(pieces, emit, 1, 1)
    return {int(k): float(s) / len(points) for (k,), (s,) in zip(keys, sums, strict=True)}


@dataclass
class Mixture:
    """Weights, means and lower triangular roots of the covariances, with the mean log-likelihood."""

    weights: np.ndarray
    means: np.ndarray
    roots: np.ndarray
    likelihood: float = -math.inf

    def memberships(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the components in each row, and the rows' log-likelihoods."""
        logs = np.empty((len(x), len(self.weights)))
        for j, (w, m, root) in enumerate(zip(self.weights, self.means, self.roots, strict=True)):
            z = np.linalg.solve(root, (x - m).T)
            logs[:, j] = math.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        top = logs.max(axis=1)
        p = np.exp(logs - top[:, None])
        total = p.sum(axis=1)
        return p / total[:, None], top + np.log(total)


def _mixture_of(sums: np.ndarray, ridge: float) -> Mixture:
    """The mixture of summed memberships: for each component a row for each of the vector's components, and one with the count."""
    n = np.maximum(sums[:, -1, 0], 1e-9)
    means = sums[:, :-1, -1] / n[:, None]
    covs = sums[:, :-1, :-1] / n[:, None, None] - means[:, :, None] * means[:, None, :] + ridge * np.eye(means.shape[1])
    covs = (covs + covs.transpose(0, 2, 1)) / 2
    low = np.linalg.eigvalsh(covs).min(axis=1)
    covs += np.maximum(ridge - low, 0.0)[:, None, None] * np.eye(means.shape[1])  # components that vanish stay regular
    return Mixture(n / n.sum(), means, np.linalg.cholesky(covs))


def mixture(rows: DataFrame, k: int, features: str = "scaled", starts: int = 10, rounds: int = 100, tolerance: float = 1e-4, ridge: float = 1e-6, seed: int = SEED) -> Mixture:
    """Gaussian mixture with full covariances by expectation maximisation (M-05).

    Starts from several k-means fits, those with equal costs once, and keeps the
    one of highest likelihood.  A step sums memberships, components and their
    products for all starts; a start ends when its mean log-likelihood gains
    less than ``tolerance``.
    """
    rows = rows.select(F.lit(0).alias("g"), vector_to_array(features).alias("x")).persist()
    try:
        first = next(iter(_starting(rows).values()), None)
        if first is None:
            raise ValueError("a mixture needs rows")
        fits = [Fit(None, k, s, spread(first, k, np.random.default_rng([seed, s, k]))) for s in range(starts)]
        lloyd(rows, fits, [0] * starts, rounds)
        states: dict[int, Mixture | np.ndarray] = {s: f.centres for s, f in enumerate({f"{f.cost:.6g}": f for f in fits}.values())}
        alive, last, dims = list(states), dict.fromkeys(states, -math.inf), first.shape[1]
        for _ in range(rounds):
            now = [(s, states[s]) for s in alive]

            def emit(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                total = np.zeros((len(now), k, dims + 1, dims + 1))
                for batch in source:
                    x = _matrix(batch.column(1))
                    for i, (_, state) in enumerate(now):
                        if isinstance(state, Mixture):
                            p, logs = state.memberships(x)
                            total[i, 0, -1, 1] += logs.sum()
                        else:  # the k-means clusters
                            p = (distances(x, state).argmin(axis=1)[:, None] == np.arange(k)).astype(float)
                        for j in range(k):
                            w = x * p[:, j : j + 1]
                            total[i, j, :-1, :-1] += w.T @ x
                            total[i, j, :-1, -1] += w.sum(axis=0)
                            total[i, j, -1, 0] += p[:, j].sum()
                i, j, r = np.meshgrid([s for s, _ in now], range(k), range(dims + 1), indexing="ij")
                yield np.column_stack([i.ravel(), j.ravel(), r.ravel()]), total.reshape(-1, dims + 1)

            keys, values = _summed(rows, emit, 3, dims + 1)
            sums = {s: np.zeros((k, dims + 1, dims + 1)) for s in alive}
            for (s, j, r), v in zip(keys.tolist(), values, strict=True):
                sums[s][j, r] = v
            going = []
            for s in alive:
                state, n = states[s], sums[s][:, -1, 0].sum()
                if isinstance(state, Mixture):
                    state.likelihood = sums[s][0, -1, 1] / n
                    if state.likelihood - last[s] < tolerance:
                        continue
                    last[s] = state.likelihood
                states[s] = _mixture_of(sums[s], ridge)
                states[s].likelihood = last[s]  # of the state before, until it is measured
                going.append(s)
            alive = going
            if not alive:
                break
        return max((m for m in states.values() if isinstance(m, Mixture)), key=lambda m: m.likelihood)
    finally:
        rows.unpersist()


def soft_clusters(rows: DataFrame, k: int, features: str = "scaled", seed: int = SEED, starts: int = 10) -> DataFrame:
    """Mixture membership, its entropy over log k, and the boundary flag above one half (M-05, F-11)."""
    m = mixture(rows, k, features, starts, seed=seed)

    def shares(x: pd.Series) -> pd.Series:
        return pd.Series(list(m.memberships(np.stack(x.to_list()))[0])) if len(x) else pd.Series([], dtype="object")

    p = F.col("probability")
    entropy = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0)) / math.log(k)
    out = rows.withColumn("probability", F.pandas_udf(shares, "array<double>")(vector_to_array(features)))
    return out.withColumns({"prediction": (F.array_position(p, F.array_max(p)) - 1).cast("int"), "entropy": entropy}).withColumn("boundary", F.col("entropy") > 0.5)
