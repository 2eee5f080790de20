"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import broadcast_if_small, discard, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each end of a link (a, b) can reach.

    Alternates large-star and small-star steps until the edges form stars.
    Every step is a grouped minimum and a join on the same key, by broadcast while
    the counted ids are few; each round is written to the shared folder, and the
    one before it deleted.  Links from an id to itself and null ends are ignored.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    for _ in range(rounds):
        # Settled if every edge leads to a root: each id has one edge down, or only edges from above.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).cast("long").alias("down")), F.struct(F.col("v").alias("x"), F.lit(1_000_000).cast("long").alias("down")))).alias("e"))
        if ends.groupBy("e.x").agg(F.sum("e.down").alias("n")).where("n > 1 and n % 1000000 > 0").isEmpty():
            break
        ids = 2 * edges.count()  # at most; a grouped minimum has a row for each
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(broadcast_if_small(low, ids), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # a row for each edge
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(broadcast_if_small(low, ids), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        before, edges = edges, stored(small, "edges")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
