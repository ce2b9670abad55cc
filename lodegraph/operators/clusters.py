"""Classes of similar components and the reference graph contracted to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodegraph.operators.components import connected_components
from lodegraph.operators.ordering import positions


class DisjointSets:
    """Union-find over 0 .. n - 1, for edges that one process holds."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.sets = n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        """Whether two sets became one."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.sets -= 1
        return True

    def same(self, a: int, b: int) -> bool:
        return self.find(a) == self.find(b)

    def clusters(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for x in range(len(self.parent)):
            out.setdefault(self.find(x), []).append(x)
        return out


def cluster(items: DataFrame, links: DataFrame) -> DataFrame:
    """(idx, cluster_id): ids 0 .. N - 1 in the order of the clusters' smallest members."""
    found = connected_components(links)
    own = items.select("idx").join(found, F.col("idx") == F.col("id"), "left").select("idx", F.coalesce("component", "idx").alias("root"))
    ids = positions(own.select("root").distinct(), "cluster_id", F.col("root"))
    return own.join(ids, "root").select("idx", F.col("cluster_id").cast("int").alias("cluster_id"))


def cluster_scores(items: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """cluster() of the pairs (i, j, score) at or above the threshold."""
    return cluster(items, scores.where(F.col("score") >= threshold).select(F.col("i").alias("a"), F.col("j").alias("b")))


def members(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_list("idx")).alias("members"))


def cluster_edges(uses: DataFrame, named: DataFrame) -> DataFrame:
    """(src, dst), distinct and without loops.

    uses: cluster_id, target; named: idx, qualified_name, cluster_id. A name that
    several components bear stands for the last of them; other targets are dropped.
    """
    last = named.groupBy(F.col("qualified_name").alias("target")).agg(F.max_by("cluster_id", "idx").alias("dst"))
    return uses.join(last, "target").select(F.col("cluster_id").alias("src"), "dst").where("src <> dst").distinct()
