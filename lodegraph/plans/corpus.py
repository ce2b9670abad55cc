"""The whole ranking: components, similarity, classes, graph, weights, ranks."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodegraph.functions.lines import split_lines
from lodegraph.operators import clusters, ranking, references, similarity
from lodegraph.operators.checkpoints import cut
from lodegraph.sources.trees import source_files

# Fixed value: default of the clustering.
THRESHOLD = 0.80
log = logging.getLogger("lodegraph")


def sequence_column(method: str, language: str, text: Column) -> Column:
    """What a measure compares: lines, or tokens of the language."""
    return split_lines(text) if similarity.check_method(method) == "diff" else references.token_column(language, text)


def rank_items(items: DataFrame, method: str = "diff", threshold: float = THRESHOLD, damping: float = ranking.DAMPING, epsilon: float = ranking.EPSILON, max_iter: int = ranking.MAX_ITER, solver: str = "power", verbose: bool = False) -> DataFrame:
    """(rank, qualified_name, weight, cluster_id, idx), ordered by falling weight, then idx.

    verbose logs each step with its counts, which are further jobs.

    items: idx (0, 1, 2 ...), qualified_name, uses array<string>, seq array<string>.
    """
    links = similarity.similarity_links(items.select("idx", "seq"), method, threshold)
    if verbose:
        n, links = items.count(), cut(links)
        log.info("2/7 %d pairs by %s, %d links at %.2f or more", n * (n - 1) // 2, method, links.count(), threshold)
    grouped = cut(items.select("idx", "qualified_name", "uses").join(clusters.cluster(items, links), "idx"))
    edges = clusters.cluster_edges(grouped.select("cluster_id", F.explode("uses").alias("target")), grouped)
    nodes = grouped.select(F.col("cluster_id").alias("node")).distinct()
    if verbose:
        edges = cut(edges)
        log.info("3/7 %d classes", nodes.count())
        log.info("4/7 %d references between classes", edges.count())
        log.info("5/7 walk with damping %.2f", damping)
    weight = cut(ranking.weights(nodes, edges, solver, damping, epsilon, max_iter, limit=None))
    if verbose:
        log.info("6/7 weights by %s, their sum %.10f", solver, weight.agg(F.sum("weight")).first()[0])
    spread = grouped.join(weight, grouped["cluster_id"] == weight["node"]).select("idx", "qualified_name", "cluster_id", "weight")
    out = ranking.ranked(spread).select("rank", "qualified_name", "weight", "cluster_id", "idx").orderBy(F.desc("weight"), "idx")
    if verbose:
        best = out.first()
        log.info("7/7 ranked, the first is %s with %.8f", best.qualified_name, best.weight)
    return out


def corpus_items(spark: SparkSession, root: str, language: str = "java", method: str = "diff", engine: str | None = None) -> DataFrame:
    """Components of a source tree as items of rank_items()."""
    found = references.components(source_files(spark, root, language), language, engine)
    return found.select(F.col("corpus_index").alias("idx"), "qualified_name", "uses", sequence_column(method, language, F.col("text")).alias("seq"))


def rank_corpus(
    spark: SparkSession, root: str, language: str = "java", engine: str | None = None, method: str = "diff", threshold: float = THRESHOLD, damping: float = ranking.DAMPING, epsilon: float = ranking.EPSILON, max_iter: int = ranking.MAX_ITER, solver: str = "power", verbose: bool = False,
) -> DataFrame:
    """(rank, qualified_name, weight) of the components under `root`, best first.

    RuntimeError if no component is found or the iteration does not converge;
    ValueError for unknown names.
    """
    references.get_engine(language, engine)
    similarity.check_method(method)
    items = cut(corpus_items(spark, root, language, method, engine))
    n = items.count()
    if not n:
        raise RuntimeError(f"'{root}' holds no component of {language}")
    if verbose:
        listed = source_files(spark, root, language).count()
        log.info("1/7 read %d of %d %s files, %d left out", n, listed, language, listed - n)
    try:
        return rank_items(items, method, threshold, damping, epsilon, max_iter, solver, verbose).select("rank", "qualified_name", "weight")
    except PySparkException as e:
        if "did not converge" in str(e):
            raise ranking._not_converged(max_iter, epsilon) from e
        raise
