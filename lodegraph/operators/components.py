"""Connected components by alternating large-star and small-star rounds.

Both steps only need the smallest neighbour of each node, an aggregate with
map-side combining. It is kept before the join that hands it back, so that both
sides of that join are plain shuffles: a node with very many edges is then
spread over tasks by adaptive skew handling, which leaves aggregates alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodegraph.operators.checkpoints import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v): every u points its neighbours at the smallest of them and itself."""
    low = cut(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
    moved = edges.join(low, "u")
    if small:
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) pairs of ids -> (id, component): the smallest id reachable, for ids on an edge.

    Nulls, loops and repeated pairs are ignored; an empty table gives an empty one.
    """
    given = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct())
    loops = given.where("u = v").select(F.col("u").alias("id"))
    now = given.where("u <> v")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, small=False)
        now = cut(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small=True))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    alone = loops.distinct().select("id", F.col("id").alias("component"))
    return found.union(roots).union(alone).groupBy("id").agg(F.min("component").alias("component"))
