from __future__ import annotations

import difflib
import json
import random
import re
import sys
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodegraph import __main__ as cli, sinks
from lodegraph.functions import sequences
from lodegraph.functions.sequences import block_length, lcs_length, neighbours_bound, overlap_bound
from lodegraph.operators import clusters, ordering, ranking, similarity
from lodegraph.operators.components import connected_components
from lodegraph.plans import corpus


def score(a, b, method, threshold=None):
    return sequences.similarity(a, b, similarity.METHODS[method], threshold)


def items(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "idx int, seq array<string>")


def graph(spark, adjacency):
    nodes = spark.createDataFrame([(k,) for k in adjacency], "node int")
    edges = spark.createDataFrame([(a, b) for a, to in adjacency.items() for b in to], "src int, dst int")
    return nodes, edges


def solve(spark, adjacency, **options):
    return [r.weight for r in ranking.weights(*graph(spark, adjacency), **options).orderBy("node").collect()]


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
@settings(max_examples=300, deadline=None)
def test_shared_lengths(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][-1]))
    assert lcs_length(a, b) == rows[-1][-1]
    assert block_length(a, b) <= lcs_length(a, b) <= overlap_bound(a, b)


def test_scores():
    assert score(["a\n", "b\n"], ["a\n", "b\n"], "diff") == 1.0
    for method in ("diff", "token"):
        assert score([], [], method) == 1.0 and score(["a"], [], method) == 0.0
    assert score(list("abc"), list("xyz"), "diff") == 0.0
    assert score(["x"] * 100, ["x"] * 5, "diff") == 0.0 and score(["x"] * 50, ["x"] * 5, "diff") > 0
    assert score(["x", "y"], ["y", "z"], "diff") == pytest.approx(1 / 3)
    assert (score("aacaa", "acbaa", "diff"), score("acbaa", "aacaa", "diff")) == (2 / 8, 4 / 6)
    long = [str(i) for i in range(2001)]
    assert score(long, long[1:] + ["q"], "token") == pytest.approx(2000 / 2002)
    assert score(list("abcd"), list("abxy"), "diff", threshold=0.8) == 0.0
    with pytest.raises(ValueError, match="is called 'bogus'"):
        similarity.check_method("bogus")


@pytest.mark.parametrize("method", ["diff", "token"])
@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_pruned_join_equals_all_pairs(spark, method, threshold):
    rng = random.Random(threshold)
    seqs = [[rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(25)]
    seqs += [seqs[3], [], [], seqs[3][:-1], ["}"] * 7, ["}"] * 8]
    rng.shuffle(seqs)
    table = items(spark, seqs)
    want = clusters.cluster_scores(table, similarity.all_pairs(table, method), threshold)
    got = clusters.cluster(table, similarity.similarity_links(table, method, threshold))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_own_measure(spark, monkeypatch):
    """A measure of one's own takes part in the pruned join, in both orders that occur."""

    class Prefix:
        def shared(self, a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    monkeypatch.setattr(similarity, "METHODS", dict(similarity.METHODS))
    similarity.register_method("prefix", Prefix())
    assert similarity.available_methods() == ["diff", "token", "prefix"]
    table = items(spark, [list("abcdefghij"), list("abcdefghix"), list("jbcdefghia"), list("abcdefghij")])
    got = clusters.cluster(table, similarity.similarity_links(table, "prefix", 0.8))
    assert {r.idx: r.cluster_id for r in got.collect()} == {0: 0, 1: 0, 2: 1, 3: 0}


def test_threshold_edges(spark):
    table = items(spark, [["a"], ["b"], []])
    for threshold, n in ((0.0, 1), (-1.0, 1), (1.5, 3), (1.0, 3)):
        assert clusters.cluster(table, similarity.similarity_links(table, "diff", threshold)).agg(F.countDistinct("cluster_id")).first()[0] == n


@pytest.mark.parametrize(
    "n, pairs, want",
    [(4, [], [[0], [1], [2], [3]]), (3, [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)], [[0, 1, 2]]), (3, [(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.5)], [[0, 1, 2]]), (4, [(0, 1, 0.9), (2, 3, 0.85), (0, 2, 0.1)], [[0, 1], [2, 3]]), (3, [(0, 2, 0.8)], [[0, 2], [1]])],
)
def test_clusters(spark, n, pairs, want):
    table = items(spark, [[str(i)] for i in range(n)])
    got = clusters.cluster_scores(table, spark.createDataFrame(pairs, "i int, j int, score double"), 0.8)
    rows = clusters.members(got).orderBy("cluster_id").collect()
    assert [list(r.members) for r in rows] == want and [r.cluster_id for r in rows] == list(range(len(want)))


def test_disjoint_sets():
    s = clusters.DisjointSets(6)
    assert s.union(0, 1) and s.union(1, 2) and not s.union(0, 2) and s.same(0, 2) and not s.same(0, 3) and s.sets == 4
    assert sorted(map(sorted, s.clusters().values())) == [[0, 1, 2], [3], [4], [5]]


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (rng.randrange(200, 260), 200), (None, 1), (7, 3)] + [(300, k) for k in range(301, 340)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    s = clusters.DisjointSets(600)
    for a, b in edges:
        if a is not None:
            s.union(a, b)
    ids = {x for e in edges if e[0] is not None for x in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {x: s.find(x) for x in ids}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_star(spark):
    """A hub's edges are spread: the join that hands its smallest neighbour back is split by adaptive execution."""
    from lodegraph.operators import components

    n = 100_000
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    settings_ = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    before = {k: spark.conf.get(k, None) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        star = components._star(both.repartition(8), small=False)
        star.write.format("noop").mode("overwrite").save()
        counted = connected_components(edges)
        assert counted.count() == n and counted.where("component <> 0").count() == 0
        joined = components._star(both.repartition(8), small=False)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_next_in_group(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["x", "y", None]) if k % 3 else "z", rng.randrange(1000)) for k in range(2_000)]
    got = ordering.next_in_group(spark.createDataFrame(rows, "k int, g string, v int").repartition(6), "after", "g", "v", "k").collect()
    want = {}
    for g in ("x", "y", "z", None):
        own = [r for r in rows if r[1] == g]
        want |= {a[0]: b[2] if b else None for a, b in zip(own, [*own[1:], None], strict=True)}
    assert len(got) == 2_000 and {r.k: r.after for r in got} == want
    assert ordering.next_in_group(spark.createDataFrame([], "k int, g string, v int"), "after", "g", "v", "k").count() == 0


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lodegraph.operators import checkpoints

    def fake(master, named):
        made = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: named)), made

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoints.ensure_dir(fake("spark://host:7077", None)[0])
    for master, named in (("local[4]", None), ("local", None), ("yarn", "hdfs://x/y")):
        session, made = fake(master, named)
        checkpoints.ensure_dir(session)
        assert len(made) == 1 and (named is None or made == [named])


def test_cluster_edges(spark):
    named = spark.createDataFrame([(0, "A", 0), (1, "A2", 0), (2, "B", 1), (3, "D", 2), (4, "D", 3)], "idx int, qualified_name string, cluster_id int")
    uses = spark.createDataFrame([(0, "B"), (0, "B"), (0, "A2"), (1, "D"), (1, "missing")], "cluster_id int, target string")
    assert sorted(map(tuple, clusters.cluster_edges(uses, named).collect())) == [(0, 1), (1, 3)]


def test_few_candidates(spark, monkeypatch):
    """A rare element in common doesn't make two sequences a pair to align, and pairs in blocks are those of the definition."""
    rng = random.Random(4)
    texts = [[f"w{k // 2}", *(rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(60))] for k in range(80)]
    texts += [[*t[:30], str(k), *t[31:]] for k, t in enumerate(texts[:6] * 5)] + [[], [], ["x"], ["x", "x"], texts[3]]
    last = len(texts) - 1  # a copy
    table = spark.createDataFrame(list(enumerate(texts)), "idx int, seq array<string>").repartition(5)
    want = {(r.i, r.j) for r in similarity.all_pairs(table, "token").where("score >= 0.8").collect() if texts[r.i] != texts[r.j] and r.j < last}
    _, distinct, occurring = similarity.survey(table)
    found = {(r.a, r.b) for r in similarity.candidates(table, distinct, occurring, 0.8).collect()}
    assert want and found >= {(i, j) for i, j in want if texts[i]} and len(found) <= len(want) + 5
    monkeypatch.setattr(similarity, "TOGETHER", 4)
    assert {(r.a, r.b) for r in similarity.similar_sequences(table, "token", 0.8).collect()} == want
    shared = {(i, j): overlap_bound(texts[i], texts[j]) for i in range(last) for j in range(i + 1, last) if texts[i] != texts[j]}
    enough = {(i, j): n for (i, j), n in shared.items() if n >= 0.4 * (len(texts[i]) + len(texts[j]) - n) - 1e-9 and n}
    assert {(r.a, r.b): r.overlap for r in similarity.overlaps(table, 0.4).collect()} == enough


def test_json_rows_of_small_weights(spark):
    """Numbers as Python writes them, which to_json() doesn't below 0.001."""
    import json

    from lodegraph import sinks

    values = [1.0, 0.5, 0.001, 0.000987, 0.0001, 0.00012, 0.00009, 1.1e-05, 9.99999e-05, 1e-10, 0.0, 0.1234567891, 3e-11, 0.00009999999999]
    table = spark.createDataFrame([(k, f'a"{k}', v) for k, v in enumerate(values)], "rank int, name string, weight double")
    rows = [r[0] for r in table.select(sinks.json_row(F.col("rank"), F.col("name"), F.col("weight"))).collect()]
    assert rows == [json.dumps({"rank": k, "qualified_name": f'a"{k}', "weight": round(v, 10)}, separators=(",", ":")) for k, v in enumerate(values)]


P = 0.85


@pytest.mark.parametrize("adjacency", [{0: [1, 2], 1: [0], 2: [0, 1]}, {0: [1], 1: [], 2: [0]}, {0: []}, {0: [1, 2, 3], 1: [], 2: [], 3: []}])
def test_transition(spark, adjacency):
    n = len(adjacency)
    nodes, edges = graph(spark, adjacency)
    got = {(r.src, r.dst): r.prob for r in ranking.transition(nodes, edges, P).collect()}
    for i, to in adjacency.items():
        for j in adjacency:
            want = 1.0 if n == 1 else 1 / n if not to else (P / len(to) if j in to else 0) + (1 - P) / n
            assert got[i, j] == pytest.approx(want, abs=1e-12)
    ranking.check_rows(ranking.transition(nodes, edges, P))
    assert {r.node for r in ranking.sinks(nodes, edges).collect()} == {i for i, to in adjacency.items() if not to}
    assert {r.node: r.out_degree for r in ranking.out_degrees(nodes, edges).collect()} == {i: len(to) for i, to in adjacency.items()}


def test_matrix_of_small_graphs_only(spark):
    nodes = spark.range(ranking.EIGEN_NODES + 1).select(F.col("id").alias("node"))
    edges = nodes.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).limit(5)
    for make in (lambda: ranking.transition(nodes, edges), lambda: ranking.weights(nodes, edges, "eigen")):
        with pytest.raises(ValueError, match="up to"):
            make()


@pytest.fixture(scope="module")
def large(spark):
    """More nodes than the dense matrix is formed for by default, some of them sinks."""
    rng = random.Random(8)
    n = ranking.EIGEN_NODES + 50
    edges = sorted({(a, b) for a in range(n) if a % 7 for b in (rng.randrange(n), rng.randrange(n // 9)) if a != b})
    return n, spark.range(n).select(F.col("id").alias("node")), spark.createDataFrame(edges, "src long, dst long")


def test_eigenvector_of_a_large_graph(large):
    _, nodes, edges = large
    want = {r.node: r.weight for r in ranking.weights(nodes, edges, epsilon=1e-14).collect()}
    assert {r.node: r.weight for r in ranking.weights(nodes, edges, "eigen", limit=None).collect()} == pytest.approx(want, abs=1e-10)


def test_rows_of_a_large_graph(spark, large):
    n, nodes, edges = large
    got = {r.src: r.total for r in ranking.transition_sums(nodes, edges).collect()}
    assert len(got) == n and got == pytest.approx(dict.fromkeys(range(n), 1.0), abs=1e-10)
    few = spark.range(4).select(F.col("id").alias("node"))
    some = spark.createDataFrame([(0, 1), (0, 9), (2, 0)], "src long, dst long")  # 9 is no node
    want = {r.src: r.total for r in ranking.row_sums(ranking.transition(few, some)).collect()}
    assert {r.src: r.total for r in ranking.transition_sums(few, some).collect()} == pytest.approx(want, abs=1e-12)


def test_matrix_of_a_large_graph(large):
    n, nodes, edges = large
    matrix = ranking.transition(nodes, edges, limit=None)
    own = matrix.where("src in (0, 1)").agg(F.count("*"), F.sum("prob")).first()
    assert own[0] == 2 * n and own[1] == pytest.approx(2, abs=1e-9)


def _shuffled(spark, make) -> int:
    """Records that making rows writes to shuffles."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    before = {x.stageId() for x in _stages(store, sc)}
    make().write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(x.shuffleWriteRecords() for x in _stages(store, sc) if x.stageId() not in before)


def _stages(store, sc) -> list:
    found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def test_pairs_of_a_matrix_are_not_shuffled(spark, large):
    n, nodes, edges = large
    matrix = ranking.transition(nodes, edges, limit=None)
    assert _shuffled(spark, lambda: matrix) < n * n / 100
    assert matrix.count() == n * n


def test_matrix_in_blocks(spark, monkeypatch):
    """Cells of few nodes give the definition, also for a node without a name, links to what is no node, and no nodes at all."""
    monkeypatch.setattr(ranking, "BLOCK", 5)
    monkeypatch.setattr(ranking, "STRETCH", 3)
    rng = random.Random(5)
    n, edges = 41, sorted({(a, b) for a in range(40) if a % 6 for b in rng.choices(range(45), k=6) if a != b})
    nodes = spark.createDataFrame([(k,) for k in [None, *range(n - 1)]], "node int")
    to = {a: {b for x, b in edges if x == a} for a, _ in edges}
    want = {(a, b): 1 / n if a not in to else (P / len(to[a]) if b in to[a] else 0) + (1 - P) / n for a in [None, *range(n - 1)] for b in [None, *range(n - 1)]}
    rows = ranking.transition(nodes, spark.createDataFrame(edges, "src long, dst long"), P, digits=6).collect()
    assert len(rows) == n * n and {(r.src, r.dst): r.prob for r in rows} == {k: pytest.approx(round(v, 6), abs=1e-12) for k, v in want.items()}
    assert ranking.transition(nodes.limit(0), spark.createDataFrame([], "src int, dst int"), P).count() == 0


def test_pairs_that_share_little_travel_packed(spark, monkeypatch):
    """Sequences that meet in elements all over, of which few pairs are near; small chunks and buckets."""
    monkeypatch.setattr(similarity, "CHUNK", 5_000)
    rng = random.Random(12)
    rows = [(i, [str(rng.randrange(120)) for _ in range(60)]) for i in range(500)]
    rows += [(500 + i, [*rows[i][1][:20], "x", *rows[i][1][20:]]) for i in range(0, 500, 50)]
    items = spark.createDataFrame(rows, "idx int, seq array<string>")
    _, sequences, occurring = similarity.survey(items)
    found = []

    def make():
        found.append(similarity.candidates(items, sequences, occurring, 0.8))
        return found[0]

    assert _shuffled(spark, make) < 40_000  # 129795 pairs of sequences
    assert {(i, 500 + i) for i in range(0, 500, 50)} <= {(r.a, r.b) for r in found[0].collect()}
    got = {(r.a, r.b): r.score for r in similarity.similar_sequences(items, "token", 0.8).collect()}
    assert got == {(i, 500 + i): pytest.approx(60 / 61) for i in range(0, 500, 50)}


def test_blocks_as_difflib_finds_them():
    rng = random.Random(3)
    for t in range(1500):
        m = rng.choice([1, 2, 3, 6, 30])
        a = [rng.randrange(m) for _ in range(rng.randrange(70))]
        b = [rng.randrange(m) for _ in range(rng.randrange(70))] if t % 2 else [y for x in a if rng.random() < 0.9 for y in ([x] if rng.random() < 0.9 else [x, rng.randrange(m)])]
        want = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert block_length(a, b) == want <= lcs_length(a, b) <= neighbours_bound(a, b)


def test_long_texts_of_frequent_words_are_aligned_soon():
    """Words as frequent as in a language; looked up one by one, they took 3 s a pair of this size."""
    rng = random.Random(4)
    a = [min(int(rng.paretovariate(0.7)), 20_000) for _ in range(6_000)]
    b = [x for x in a if rng.random() < 0.96]
    began = time.process_time()
    assert block_length(a, b) <= lcs_length(a, b) == len(b)
    assert time.process_time() - began < 1


def test_bad_rows(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        ranking.check_rows(spark.createDataFrame([(0, 0, 0.5)], "src int, dst int, prob double"))


CASES = [
    ({0: [1], 1: [2], 2: [3], 3: []}, [0.116155823, 0.2148882726, 0.2988108548, 0.3701450496]),
    ({0: [1], 1: [2], 2: []}, [0.1844167819, 0.3411710466, 0.4744121715]),
    ({k: [(k + 1) % 5] for k in range(5)}, [0.2] * 5),
    ({0: []}, [1.0]),
    ({0: [1], 1: [0]}, [0.5, 0.5]),
    ({0: [1, 2], 1: [0], 2: [1]}, [0.3877897117, 0.3973996608, 0.2148106275]),
    ({0: [1, 2], 1: [0], 2: [1, 0]}, [0.432748538, 0.3333333333, 0.2339181286]),
]


@pytest.mark.parametrize("adjacency, want", CASES)
@pytest.mark.parametrize("options", [{}, {"solver": "eigen"}])
def test_weights(spark, adjacency, want, options):
    assert solve(spark, adjacency, **options) == pytest.approx(want, abs=1e-8)


def test_weights_by_joins(spark):
    assert solve(spark, CASES[0][0], by_joins=True, epsilon=1e-6) == pytest.approx(CASES[0][1], abs=1e-5)


def test_fixed_steps_by_joins(spark):
    """Exactly max_iter steps on both paths, converged or not."""
    for steps, epsilon in ((3, 1e-100), (5, 10.0)):
        nodes, edges = graph(spark, CASES[0][0])
        one, joins = ({r.node: r.weight for r in ranking.weights(nodes, edges, epsilon=epsilon, max_iter=steps, fixed_steps=True, by_joins=k).collect()} for k in (False, True))
        assert joins == pytest.approx(one, abs=1e-12) and len(joins) == 4


def test_no_convergence(spark):
    with pytest.raises(RuntimeError, match="did not converge"):
        solve(spark, {0: [1], 1: []}, max_iter=0)
    with pytest.raises(Exception, match="did not converge"):
        solve(spark, {0: [1], 1: []}, epsilon=1e-100, max_iter=1)
    with pytest.raises(RuntimeError, match="did not converge"):
        solve(spark, {0: [1], 1: []}, epsilon=1e-100, max_iter=1, by_joins=True)
    assert ranking.power_kernel(2, np.array([0]), np.array([1]), P, 0, 1, fixed=True) == pytest.approx([0.2875, 0.7125])
    for bad in ({"damping": 1.5}, {"solver": "magic"}):
        with pytest.raises(ValueError):
            solve(spark, {0: []}, **bad)


def test_ranks(spark):
    table = spark.createDataFrame([(i, w) for i, w in enumerate([2.0, 3.0, 1.0, 2.0, 0.5, 0.5])], "i int, weight double")
    assert [(r.i, r["rank"]) for r in ranking.ranked(table).orderBy("i").collect()] == [(0, 2), (1, 1), (2, 4), (3, 2), (4, 5), (5, 5)]
    many = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("v"))
    got = ordering.positions(many, "p", F.col("v")).orderBy("p").collect()
    assert [r.p for r in got] == list(range(5000)) and [r.v for r in got] == sorted(r.v for r in got)


ROWS = [(1, "a,b", 0.5), (2, "c", 0.123456789012)]


def test_formats(spark):
    assert sinks.render(ROWS, "csv") == 'rank,qualified_name,weight\r\n1,"a,b",0.5000000000\r\n2,c,0.1234567890\r\n'
    assert json.loads(sinks.render(ROWS, "json"))[1] == {"rank": 2, "qualified_name": "c", "weight": 0.123456789}
    assert sinks.render(ROWS).splitlines()[3] == "|    1 | a,b       | 0.50000000 |"
    table = spark.createDataFrame(ROWS, "rank int, qualified_name string, weight double").coalesce(1)
    assert sinks.format_output(table, "csv", 1) == sinks.render(ROWS[:1], "csv") and sinks.format_output(table, "json", 0) == "[]"
    for bad in [lambda: sinks.render(ROWS, "xml"), lambda: sinks.top(table, -1)]:
        with pytest.raises(ValueError):
            bad()


def test_corpus(spark, tmp_path, capsys, caplog):
    for name, text in {"a.py": "import b\nimport c\n", "a2.py": "import b\nimport c\n", "b.py": "import c\nx = 1\n", "c.py": "y = 2\nz = 3\n", "e1.py": "", "e2.py": ""}.items():
        (tmp_path / name).write_text(text)
    rows = corpus.rank_corpus(spark, str(tmp_path), "python").collect()
    assert [r.qualified_name for r in rows[:2]] == ["c", "b"] and {r.qualified_name: r["rank"] for r in rows}["e1"] == {r.qualified_name: r["rank"] for r in rows}["e2"]
    by_name = {r.qualified_name: r.weight for r in rows}
    assert by_name["a"] == by_name["a2"] and len(rows) == 6
    shuffled = corpus.rank_items(corpus.corpus_items(spark, str(tmp_path), "python").repartition(3)).select("rank", "qualified_name", "weight").collect()
    assert [tuple(r) for r in shuffled] == [tuple(r) for r in rows]
    assert cli.main([str(tmp_path), "-l", "python", "-f", "json", "-n", "1", "-s", "token"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["qualified_name"] == "c"
    assert cli.main([str(tmp_path), "-l", "python", "--parser", "nope"], spark) == 1
    assert cli.main([str(tmp_path), "-l", "java"], spark) == 1
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / "missing")], spark)
    (tmp_path / "bad.py").write_text("def (:")
    with caplog.at_level("INFO", logger="lodegraph"):
        corpus.rank_corpus(spark, str(tmp_path), "python", verbose=True).collect()
    said = [r.message for r in caplog.records]
    assert [m[:3] for m in said] == [f"{k}/7" for k in range(1, 8)]
    assert "read 6 of 7 python files, 1 left out" in said[0] and "15 pairs" in said[1] and "4 classes" in said[2] and "3 references" in said[3] and "sum 1.0000000000" in said[5] and "is c with" in said[6]
    with pytest.raises(Exception, match="did not converge"):
        corpus.rank_corpus(spark, str(tmp_path), "python", epsilon=1e-300, max_iter=2).collect()


def test_overlaps_leave_no_shuffles_behind_checkpoints(spark, monkeypatch):
    held = lambda: set(re.findall(r"\d+", spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().toString()))
    taken, real = [], type(spark.range(1)).checkpoint

    def checkpoint(df, eager=True):
        before = held()
        out = real(df, eager)
        frame = sys._getframe(2)
        if "similarity" in (frame.f_back if frame.f_code.co_name == "cut_alone" else frame).f_code.co_filename:
            taken.append(held() - before)
        return out

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", checkpoint)
    items = spark.createDataFrame([(i, [f"w{i % 3}{k}" for k in range(20)] + [f"x{i}"]) for i in range(12)], "idx long, seq array<string>")
    found = similarity.overlaps(items, 0.4)
    assert any(taken) and not held() & set().union(*taken)
    assert {(r.a, r.b, r.overlap) for r in found.collect()} == {(a, b, 20) for a in range(12) for b in range(a + 3, 12, 3)}
