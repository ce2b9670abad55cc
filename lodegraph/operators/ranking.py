"""Stationary weights of the damped walk on a directed graph.

The walk's matrix is never formed: with sink mass z and damping p, a node gets
(1 - p) / N + p * z / N, and p * weight / out-degree from each node that refers
to it. Graphs of up to KERNEL_NODES nodes and KERNEL_EDGES edges are solved in
one task, larger ones by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lodegraph.operators.checkpoints import cut
from lodegraph.operators.ordering import competition_rank

# Defaults of the ranking.
DAMPING, EPSILON, MAX_ITER = 0.85, 1e-10, 1000
KERNEL_NODES, KERNEL_EDGES, EIGEN_NODES = 1_000_000, 10_000_000, 3_000
#: Of the matrix: nodes of a block, targets of a stretch of rows, cells of a task, and tasks at least if there are as many cells.
BLOCK, STRETCH, CELLS, LEAST_TASKS = 1_024, 256, 16, 64


def transition(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, limit: int | None = EIGEN_NODES, digits: int | None = None) -> DataFrame:
    """(src, dst, prob) of all pairs of nodes: the definition. nodes: distinct (node); edges: distinct (src, dst); limit: nodes at most, None for any number; digits: decimals of prob, None for all.

    Pairs are formed where they are returned, in cells of two blocks of nodes. Only
    edges are shuffled, to their cells; nodes, of which there are few next to their
    pairs, are broadcast with the two values of their row.
    """
    n = nodes.count()
    if limit is not None and n > limit:
        raise ValueError(f"the matrix is formed for up to {limit} nodes, not {n}")
    if n < 2:
        return nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("prob"))
    kind, blocks = dict(nodes.dtypes)["node"], -(-n // BLOCK)

    def block(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast(kind)), F.lit(blocks))

    def rounded(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    degree, rest = edges.groupBy("src").agg(F.count("*").alias("degree")), F.lit((1 - damping) / n)
    other = rounded(F.when(F.col("degree").isNull(), F.lit(1.0 / n)).otherwise(rest))
    own = nodes.select(F.col("node").alias("src")).join(degree, "src", "left").select("src", other.alias("other"), rounded(F.lit(damping) / F.col("degree") + rest).alias("linked"))
    rows = own.groupBy(block("src").alias("src_block")).agg(F.collect_list(F.struct("src", "other", "linked")).alias("rows"))
    columns = nodes.groupBy(block("node").alias("dst_block")).agg(F.collect_list(F.struct(F.col("node").alias("dst"))).alias("columns"))
    link = F.struct(*(F.col(c).cast(kind).alias(c) for c in ("src", "dst")))
    cells = nodes.sparkSession.range(blocks * blocks).select(F.col("id").alias("cell"), F.lit(None).cast(f"struct<src:{kind},dst:{kind}>").alias("link"))
    dealt = edges.select((block("src") * blocks + block("dst")).alias("cell"), link.alias("link")).union(cells)
    tasks = min(blocks * blocks, max(LEAST_TASKS, -(-blocks * blocks // CELLS)))
    links = dealt.repartition(tasks, "cell").groupBy("cell").agg(F.collect_list("link").alias("links"))
    placed = links.select("links", F.expr(f"cell div {blocks}").alias("src_block"), (F.col("cell") % blocks).alias("dst_block"))
    whole = placed.join(F.broadcast(rows), "src_block").join(F.broadcast(columns), "dst_block").select("rows", "columns", "links")
    return whole.mapInArrow(_cells, f"src {kind}, dst {kind}, prob double")


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each cell, in stretches of STRETCH targets, which repeat and so pack well where they are written."""
    for batch in it:
        for k in range(batch.num_rows):
            rows, columns, links = (batch.column(c)[k].values for c in ("rows", "columns", "links"))
            src, dst = rows.field("src"), columns.field("dst")
            other, linked = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("other", "linked"))
            prob = np.repeat(other[:, None], len(dst), axis=1)
            i, j = (pc.fill_null(pc.index_in(links.field(c), value_set=x, skip_nulls=True), -1).to_numpy() for c, x in (("src", src), ("dst", dst)))
            use = (i >= 0) & (j >= 0)
            prob[i[use], j[use]] = linked[i[use]]
            for begin in range(0, len(dst), STRETCH):
                part = prob[:, begin : begin + STRETCH]
                at = np.indices(part.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([src.take(pa.array(at[0])), dst.take(pa.array(at[1] + begin)), pa.array(part.ravel())], names=["src", "dst", "prob"])


def row_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("src").agg(F.sum("prob").alias("total"))


def transition_sums(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(src, total): row_sums() of transition(), from each row's links and the one value of all its other pairs, which are not formed."""
    n = nodes.count()
    rest = (1 - damping) / n if n else 0.0
    linked = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.count("*").alias("links"))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    rows = nodes.select(F.col("node").alias("src")).join(degree, "src", "left").join(linked, "src", "left")
    links = F.coalesce("links", F.lit(0))
    total = links * (F.lit(damping) / F.col("degree") + rest) + (F.lit(n) - links) * rest
    even = F.lit(1.0 / n * n if n else 0.0)
    return rows.select("src", F.lit(1.0).alias("total") if n == 1 else F.when(F.col("degree").isNull(), even).otherwise(total).alias("total"))


def check_rows(matrix: DataFrame, tolerance: float = 1e-10) -> None:
    bad = row_sums(matrix).where(F.abs(F.col("total") - 1) > tolerance).count()
    if bad:
        raise ValueError(f"{bad} rows of the matrix don't sum to 1")


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree), sinks with 0."""
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    return nodes.join(degree, "node", "left").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def _not_converged(steps: int, epsilon: float) -> RuntimeError:
    return RuntimeError(f"the weights did not converge in {steps} steps to a change below {epsilon}")


def power_kernel(n: int, src: np.ndarray, dst: np.ndarray, damping: float, epsilon: float, max_iter: int, fixed: bool = False) -> np.ndarray:
    """Weights of nodes 0 .. n - 1; fixed: stop after max_iter steps whatever the change."""
    degree = np.bincount(src, minlength=n).astype(float)
    sink, share = degree == 0, damping / np.maximum(degree, 1)
    w = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        new = np.bincount(dst, (w * share)[src], n) + (1 - damping) / n * w[~sink].sum() + w[sink].sum() / n
        new /= new.sum()
        change, w = np.abs(new - w).sum(), new
        if change < epsilon and not fixed:
            return _positive(w)
    if fixed:
        return _positive(w)
    raise _not_converged(max_iter, epsilon)


def eigen_kernel(n: int, src: np.ndarray, dst: np.ndarray, damping: float) -> np.ndarray:
    """Weights by the eigenvector of the eigenvalue 1."""
    matrix = np.full((n, n), (1 - damping) / n)
    degree = np.bincount(src, minlength=n)
    matrix[degree == 0] = 1.0 / n
    matrix[src, dst] += damping / degree[src]
    if n == 1:
        matrix[:] = 1.0
    values, vectors = np.linalg.eig(matrix.T)
    k = int(np.argmin(np.abs(values - 1)))
    if abs(values[k] - 1) > 1e-6:
        raise RuntimeError("No eigenvalue near 1 was found.")
    w = np.abs(vectors[:, k].real)
    return _positive(w / w.sum())


def krylov_kernel(n: int, src: np.ndarray, dst: np.ndarray, damping: float, size: int = 40, most: int = 1000) -> np.ndarray:
    """Weights by the eigenvector of the eigenvalue 1 without the dense matrix: restarted Arnoldi iteration on its product with a vector."""
    degree = np.bincount(src, minlength=n).astype(float)
    sink, share = degree == 0, damping / np.maximum(degree, 1)

    def step(w: np.ndarray) -> np.ndarray:
        return np.bincount(dst, (w * share)[src], n) + ((1 - damping) * w[~sink].sum() + w[sink].sum()) / n

    w = np.full(n, 1.0 / n)
    for _ in range(most):
        basis, h, k = np.empty((min(size, n) + 1, n)), np.zeros((min(size, n) + 1, min(size, n))), 0
        basis[0] = w / np.linalg.norm(w)
        while k < h.shape[1]:
            v = step(basis[k])
            for _ in range(2):  # once more for what rounding left
                part = basis[: k + 1] @ v
                h[: k + 1, k] += part
                v -= part @ basis[: k + 1]
            h[k + 1, k] = np.linalg.norm(v)
            k += 1
            if h[k, k - 1] < 1e-14:
                break
            basis[k] = v / h[k, k - 1]
        values, vectors = np.linalg.eig(h[:k, :k])
        near = int(np.argmin(np.abs(values - 1)))
        w = np.abs((vectors[:, near].real @ basis[:k]))
        w /= w.sum()
        if np.abs(step(w) - w).sum() < 1e-13:
            return _positive(w)
    raise RuntimeError("No eigenvalue near 1 was found.")


def _positive(w: np.ndarray) -> np.ndarray:
    if (w < -1e-12).any():
        raise RuntimeError("A weight is negative.")
    return np.maximum(w, 0)


def _in_one_task(nodes: DataFrame, edges: DataFrame, solve: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    kind = dict(nodes.dtypes)["node"]
    both = nodes.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst")).union(edges.select(F.col("src").cast(kind), F.col("dst").cast(kind))).withColumn("g", F.lit("all"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        alone = rows["dst"].isna()
        names = np.sort(rows.loc[alone, "src"].to_numpy().astype(np.int64))
        linked = rows[~alone].sort_values(["dst", "src"])  # sums don't depend on how rows arrive
        src, dst = (np.searchsorted(names, linked[c].to_numpy().astype(np.int64)) for c in ("src", "dst"))
        return pd.DataFrame({"node": names, "weight": solve(len(names), src, dst)})

    return both.groupBy("g").applyInPandas(run, f"node {kind}, weight double")


def _by_joins(nodes: DataFrame, edges: DataFrame, n: int, damping: float, epsilon: float, max_iter: int, fixed: bool = False) -> DataFrame:
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    linked = cut(edges.join(degree, "src"))
    w = cut(nodes.join(degree, nodes["node"] == degree["src"], "left").select("node", F.col("degree").isNull().alias("sink"), F.lit(1.0 / n).alias("weight")))
    for _ in range(max_iter):
        loose = w.where("sink").agg(F.sum("weight")).first()[0] or 0.0
        flow = linked.join(w, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.lit(damping) / F.col("degree")).alias("flow"))
        rest = (1 - damping) * (1 - loose) / n + loose / n
        new = w.join(flow, "node", "left").select("node", "sink", F.col("weight").alias("old"), (F.coalesce("flow", F.lit(0.0)) + F.lit(rest)).alias("weight"))
        new = cut(new)
        total, change = new.agg(F.sum("weight"), F.sum(F.abs(F.col("weight") - F.col("old")))).first()
        w = new.select("node", "sink", (F.col("weight") / F.lit(total)).alias("weight"))
        if change < epsilon and not fixed:
            break
    else:
        if not fixed:
            raise _not_converged(max_iter, epsilon)
    if w.where(F.col("weight") < -1e-12).limit(1).count():
        raise RuntimeError("A weight is negative.")
    return w.select("node", F.greatest("weight", F.lit(0.0)).alias("weight"))


def weights(nodes: DataFrame, edges: DataFrame, solver: str = "power", damping: float = DAMPING, epsilon: float = EPSILON, max_iter: int = MAX_ITER, fixed_steps: bool = False, by_joins: bool | None = None, limit: int | None = EIGEN_NODES) -> DataFrame:
    """(node, weight) summing to 1. nodes: distinct (node); edges: distinct (src, dst) between them.

    limit: nodes at most for the eigen solver, None for any number: beyond
    EIGEN_NODES without the dense matrix, beyond what one task holds by joins.
    """
    if not 0 <= damping <= 1:
        raise ValueError("damping must be between 0 and 1")
    if solver not in ("power", "eigen"):
        raise ValueError(f"no solver is called '{solver}'; there are: power, eigen")
    if solver == "eigen":
        n = nodes.count()
        if limit is not None and n > limit:
            raise ValueError(f"the eigen solver takes up to {limit} nodes, not {n}")
        if n > EIGEN_NODES:
            nodes, edges = cut(nodes), cut(edges)
            if n > KERNEL_NODES or edges.count() > KERNEL_EDGES:
                return _by_joins(nodes, edges, n, damping, min(epsilon, 1e-13), max_iter)
            return _in_one_task(nodes, edges, lambda n, s, d: krylov_kernel(n, s, d, damping))
        return _in_one_task(nodes, edges, lambda n, s, d: eigen_kernel(n, s, d, damping))
    if max_iter < 1:
        raise _not_converged(max_iter, epsilon)
    nodes, edges = cut(nodes), cut(edges)  # counted here, then read by every step
    n = nodes.count()
    if by_joins is None:
        by_joins = n > KERNEL_NODES or edges.count() > KERNEL_EDGES
    if by_joins:
        return _by_joins(nodes, edges, n, damping, epsilon, max_iter, fixed_steps)
    return _in_one_task(nodes, edges, lambda n, s, d: power_kernel(n, s, d, damping, epsilon, max_iter, fixed_steps))


def ranked(weighted: DataFrame, weight: str = "weight") -> DataFrame:
    """Add `rank`: competition rank by falling weight, ties by exact equality."""
    return competition_rank(weighted, "rank", weight)
