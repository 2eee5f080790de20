"""Nearest points without a limit of distance, by a tree of cells cut by counts.

Points stand on the unit sphere, whose cube is cut into cells, sixteen to an
axis at a time.  A cell of more than ``LEAF`` points is cut further, so
towns have small cells and the countryside large ones; a leaf holds its points.
Every target goes down the tree at once: of the cells it has, those stay that
may hold one of its ``k`` nearest, as proven by the counts and the boxes around
the cells' points.  No pair is made with points of other cells, and no cell
grows with the density of points.

Of points at one place only the first ``k`` by id can be among the nearest, so
the others never enter the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import haversine_km
from marlstone.operators.staging import staged

LEAF = 64
#: Binary digits of an axis, and how many are cut at a time; the smallest cells are 200 m wide.
DIGITS, STEP = 16, 4
_AXES = ("x", "y", "z")


def _on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return {"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)}


def _coarser(key: Column, digits: int) -> Column:
    """The cell, ``digits`` digits wider, that holds a cell; 21 bits of a key for each axis."""
    parts = [F.shiftleft(F.shiftright(F.shiftright(key, 21 * k).bitwiseAND((1 << 21) - 1), digits), 21 * k) for k in range(3)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def _tree(points: DataFrame, leaf: int) -> list[DataFrame]:
    """Nodes of each depth, the root of each category first: category, parent, key, n, box, items (the points of a leaf)."""
    top = (1 << DIGITS) - 1
    cell = [F.least(F.floor((F.col(a) + 1) / 2 * (1 << DIGITS)).cast("long"), F.lit(top)) for a in _AXES]
    key = cell[0].bitwiseOR(F.shiftleft(cell[1], 21)).bitwiseOR(F.shiftleft(cell[2], 42))
    box = [F.min(a).alias(f"{a}0") for a in _AXES] + [F.max(a).alias(f"{a}1") for a in _AXES]
    nodes = points.withColumn("key", key).groupBy("category", "key").agg(F.count("*").alias("n"), *box, F.collect_list(F.struct("point", "plat", "plon")).alias("items"))
    depths = []
    for depth in range(1, DIGITS // STEP + 1):
        nodes = staged(nodes.withColumn("parent", _coarser(F.col("key"), STEP * depth)))
        whole = F.sum("n").over(Window.partitionBy("category", "parent"))
        depths.append(nodes.withColumn("_all", whole).where(F.col("_all") > leaf).drop("_all"))  # the others are in their parent's items
        box = [F.min(f"{a}0").alias(f"{a}0") for a in _AXES] + [F.max(f"{a}1").alias(f"{a}1") for a in _AXES]
        # Children of more points than a leaf's have no part in a leaf, so at most a leaf's points of each child are gathered.
        items = F.flatten(F.collect_list(F.when(F.col("n") <= leaf, F.col("items"))))
        nodes = nodes.groupBy("category", F.col("parent").alias("key")).agg(F.sum("n").alias("n"), *box, items.alias("items"))
        nodes = nodes.withColumn("items", F.when(F.col("n") <= leaf, F.col("items")))
    return [staged(nodes.withColumn("parent", F.lit(0).cast("long"))), *reversed(depths)]


def _proven(frontier: DataFrame, k: int) -> DataFrame:
    """The cells of each target that may hold one of its ``k`` nearest."""
    near = sum((F.pow(F.greatest(F.col(f"{a}0") - F.col(f"t{a}"), F.col(f"t{a}") - F.col(f"{a}1"), F.lit(0.0)), 2) for a in _AXES), F.lit(0.0))
    far = sum((F.pow(F.greatest(F.abs(F.col(f"{a}0") - F.col(f"t{a}")), F.abs(F.col(f"{a}1") - F.col(f"t{a}"))), 2) for a in _AXES), F.lit(0.0))
    mine = Window.partitionBy("target", "tlat", "tlon", "category")
    reached = frontier.withColumns({"_near": near, "_far": far}).withColumn("_upto", F.sum("n").over(mine.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)))
    bound = F.min(F.when(F.col("_upto") >= k, F.col("_far"))).over(mine)
    slack = F.col("_bound") * (1 + 1e-9) + 1e-15
    return reached.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_near") <= slack)).drop("_near", "_far", "_upto", "_bound")


def nearest_per_category(targets: DataFrame, points: DataFrame) -> DataFrame:
    """target, category, km of the nearest point of each category (J-17)."""
    return nearest(targets, points, 1, "category").select("target", "category", "km")


def nearest(targets: DataFrame, points: DataFrame, k: int = 1, category: str | None = None, target_id: str = "id", point_id: str = "id", same: bool = False, leaf: int = LEAF) -> DataFrame:
    """target, category, point, km, rank: the k nearest points of each category, ties by point, however far they are (J-15, J-17).

    Both tables have lat and lon; rows without either take no part, nor do
    points without a category.  With ``same`` a target isn't its own neighbour.
    """
    most = k + 1 if same else k
    kind = F.col(category) if category else F.lit(0)
    p = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & kind.isNotNull()).select(kind.alias("category"), F.col(point_id).alias("point"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    nth = F.row_number().over(Window.partitionBy("category", "plat", "plon").orderBy("point"))
    p = p.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth").withColumns(_on_sphere(F.col("plat"), F.col("plon")))
    root, *depths = _tree(p, leaf)
    t = targets.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(target_id).alias("target"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), *[v.alias(f"t{a}") for a, v in _on_sphere(F.col("lat"), F.col("lon")).items()])
    frontier = t.crossJoin(root)  # each target has a result for each category
    mine = ["target", "tlat", "tlon", "tx", "ty", "tz"]
    for kids in depths:
        cut = F.col("items").isNull()
        below = frontier.where(cut).select("category", F.col("key").alias("parent"), *mine).join(kids, ["category", "parent"])
        frontier = _proven(frontier.where(~cut).unionByName(below.select(*frontier.columns)), most)
    met = frontier.select("target", "category", "tlat", "tlon", F.explode("items").alias("p")).select("target", "category", F.col("p.point").alias("point"), haversine_km(F.col("tlat"), F.col("tlon"), F.col("p.plat"), F.col("p.plon")).alias("km"))
    if same:
        met = met.where(F.col("target") != F.col("point"))
    rank = F.row_number().over(Window.partitionBy("target", "category").orderBy("km", "point"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)
