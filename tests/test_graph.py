"""Neighbour aggregation, adjoints and topologies on made graphs with known results."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgrid.functions.exact import order_free_sums
from loomgrid.graph.collections import patch_overlaps, random_walk_returns, stratified_folds
from loomgrid.graph.mesh import MeshGraph, disjoint_union, pooled_mean
from loomgrid.operators.running import running_sum

SOURCE, TARGET = [1, 0, 1, 3, 1, 0], [2, 1, 2, 2, 4, 2]
VALUES = [[1, 2], [3, 5], [7, 11], [13, 17], [19, 23], [29, 31]]
GRADIENT = [[1, 10], [2, 3], [5, 7], [11, 13], [17, 19], [23, 29]]


@pytest.fixture(scope="module")
def graph(spark):
    return MeshGraph.of(spark, 6, SOURCE, TARGET)


def field(spark, rows, names=("a", "b")):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "node long, " + ", ".join(f"{n} double" for n in names))


def rows(frame, *names, key="node"):
    return [list(r[1:]) for r in sorted(map(tuple, frame.select(key, *names).collect()))]


def test_sum_keeps_parallel_edges_and_empty_nodes(spark, graph):
    assert rows(graph.sum(field(spark, VALUES), ["a", "b"]), "a", "b") == [[0, 0], [1, 2], [20, 29], [0, 0], [3, 5], [0, 0]]


def test_adjoint_of_sum(spark, graph):
    assert rows(graph.sum_adjoint(field(spark, GRADIENT), ["a", "b"]), "a", "b") == [[7, 10], [27, 33], [0, 0], [5, 7], [0, 0], [0, 0]]


def test_degree_mean_and_canonical_order(spark, graph):
    assert rows(graph.in_degree(), "degree") == [[0], [1], [4], [0], [1], [0]]
    assert rows(graph.mean(field(spark, VALUES), ["a"]), "a") == [[0], [1], [5], [0], [3], [0]]
    assert sorted(map(tuple, graph.canonical().collect())) == [(1, 0, 0, 1), (2, 0, 0, 5), (2, 1, 1, 0), (2, 2, 1, 2), (2, 3, 3, 3), (4, 0, 1, 4)]


def test_weighted_sum_and_its_adjoints(spark):
    g = MeshGraph.of(spark, 3, [0, 1, 0], [2, 2, 1], w=[2, -1, 3])
    x, d = field(spark, [[2], [4], [8]], ["x"]), field(spark, [[0], [5], [7]], ["x"])
    assert rows(g.sum(x, ["x"], "w"), "x") == [[0], [6], [0]]
    assert rows(g.sum_adjoint(d, ["x"], "w"), "x") == [[29], [-7], [0]]
    assert rows(g.weight_adjoint(x, d, ["x"]), "weight", key="edge") == [[14], [28], [10]]


def test_lanes_are_independent(spark, graph):
    one = field(spark, VALUES)
    lanes = one.selectExpr("0 as lane", "*").unionByName(one.selectExpr("1 as lane", "node", "a * 10 as a", "b * 10 as b"))
    out = graph.sum(lanes, ["a", "b"], lanes=["lane"])
    assert rows(out.filter("lane = 1"), "a") == [[10 * a] for a, _ in ([0, 0], [1, 2], [20, 29], [0, 0], [3, 5], [0, 0])]
    assert out.count() == 12
    edges = spark.createDataFrame([(k, e, 1.0) for k in (0, 1) for e in range(3)], "lane int, edge long, v double")
    assert rows(graph.sum_edges(edges, ["v"], ["lane"]).filter("lane = 1"), "v") == [[0], [1], [2], [0], [0], [0]]


def test_edge_fields(spark, graph):
    x = field(spark, VALUES)
    assert rows(graph.edge_values(x, ["a"], "source"), "a", key="edge") == [[3], [1], [3], [13], [3], [1]]
    assert rows(graph.edge_values(x, ["a"], "target"), "a", key="edge") == [[7], [3], [7], [7], [19], [7]]
    edges = spark.createDataFrame([(i, float(i + 1)) for i in range(6)], "edge long, v double")
    assert rows(graph.sum_edges(edges, ["v"]), "v") == [[0], [2], [14], [0], [5], [0]]
    assert rows(graph.segment_max(edges.selectExpr("edge", "v - 10 as v"), "v"), "v") == [[0], [-8], [-4], [0], [-5], [0]]
    assert rows(graph.gather_adjoint(edges, ["v"], "source"), "v") == [[8], [9], [0], [4], [0], [0]]
    with pytest.raises(ValueError):
        graph.edge_values(x, ["a"], "middle")


def test_softmax_is_stable_and_sums_to_one(spark, graph):
    scores = spark.createDataFrame([(i, s) for i, s in enumerate([1000.0, 3.0, 1001.0, 999.0, -5000.0, 1000.0])], "edge long, s double")
    p = graph.softmax(scores, "s").join(graph.edges, "edge").groupBy("target").sum("p").collect()
    assert all(abs(r["sum(p)"] - 1) < 1e-12 for r in p) and len(p) == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations([1e20, -1e20, 1.0, 3e-7, -2.5, 1e-300]))
def test_order_free_sums(spark, values):
    """Exact whatever the order and the partitions; sums in order of the rows would lose the small ones."""
    frame = spark.createDataFrame([(0, v) for v in values], "g int, v double").repartition(3)
    assert order_free_sums(frame, ["g"], ["v"]).first()["v"] == -1.5 + 3e-7


def test_nulls_and_empty_graphs(spark):
    g = MeshGraph.of(spark, 3, [], [])
    x = spark.createDataFrame([(0, None), (1, 2.0), (2, 3.0)], "node long, x double")
    assert rows(g.sum(x, ["x"]), "x") == [[0], [0], [0]]
    g = MeshGraph.of(spark, 3, [0, 1], [2, 2])
    assert rows(g.sum(x, ["x"]), "x") == [[0], [0], [2]]
    assert rows(g.sum(x, ["x"], order_free=True), "x") == [[0], [0], [2]]


def test_product(spark):
    path, ring = MeshGraph.of(spark, 3, [0, 1], [1, 2]), MeshGraph.of(spark, 2, [0, 1], [1, 0])
    edges = sorted(map(tuple, path.cartesian(ring, 3, 2).edges.select("edge", "source", "target").collect()))
    assert [e[1] for e in edges] == [0, 1, 2, 3, 0, 1, 2, 3, 4, 5] and [e[2] for e in edges] == [2, 3, 4, 5, 1, 0, 3, 2, 5, 4]


def test_topologies(spark):
    g = MeshGraph.of(spark, 3, [0, 0, 1, 2], [1, 1, 0, 2])
    assert g.without_loops().edge_count() == 3 and g.self_only().edge_count() == 3 and g.with_loops().edge_count() == 7
    assert sorted(map(tuple, g.symmetric().edges.select("source", "target").collect())) == [(0, 1), (1, 0), (2, 2)]
    assert sorted(map(tuple, g.asymmetric_edges().collect())) == [(0, 1, 2, 1), (1, 0, 1, 2)]
    with pytest.raises(ValueError, match="loops"):
        g.require_symmetric()
    with pytest.raises(ValueError, match="symmetric"):
        g.without_loops().require_symmetric()
    assert g.without_loops().both_ways().require_symmetric()
    moved = g.relabelled(spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "node long, to long"))
    assert sorted(map(tuple, moved.edges.select("source", "target").collect())) == [(0, 2), (1, 1), (2, 0), (2, 0)]
    inner = g.induced(spark.createDataFrame([("p", 0), ("p", 1), ("q", 2)], "patch string, node long"), ["patch"])
    assert sorted((r.patch, r.source, r.target) for r in inner.collect()) == [("p", 0, 1), ("p", 0, 1), ("p", 1, 0), ("q", 2, 2)]


@pytest.mark.parametrize("nodes, source, target", [(0, [], []), (2, [0], []), (2, [0], [2]), (2, [-1], [0])])
def test_wrong_graphs_are_refused(spark, nodes, source, target):
    with pytest.raises(ValueError):
        MeshGraph.of(spark, nodes, source, target)


def test_violations(spark):
    g = MeshGraph(spark.createDataFrame([(0,), (1,), (1,)], "node long"), spark.createDataFrame([(0, 0, 5), (0, 1, None)], "edge long, source long, target long"))
    assert sorted({r.rule for r in g.violations().collect()}) == ["edge repeated", "node repeated", "null id", "target is no node"]


def test_collections(spark):
    graphs = spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "graph long, size long")
    union = disjoint_union(graphs, spark.createDataFrame([(0, 0, 0, 1), (2, 0, 2, 0)], "graph long, edge long, source long, target long"))
    assert sorted(r.node for r in union.nodes.collect()) == [0, 1, 2, 3, 4]
    assert sorted((r.source, r.target) for r in union.edges.collect()) == [(0, 1), (4, 2)]
    pooled = pooled_mean(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, x double"), spark.createDataFrame([("a",), ("b",)], "g string"), "g", ["x"])
    assert sorted(map(tuple, pooled.collect())) == [("a", 2.0), ("b", 0.0)]
    assert sorted(map(tuple, patch_overlaps(spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 1, 2)], "graph int, patch int, node int")).collect())) == [(0, 0, 0, 1), (0, 0, 1, 1), (0, 1, 0, 1), (0, 1, 1, 2)]


def test_walks_return(spark):
    """On a triangle a walk is back after two steps with probability 1/2 and after three with 1/4; a lone node never is."""
    g = MeshGraph.of(spark, 4, [0, 1, 1, 2, 2, 0], [1, 0, 2, 1, 0, 2])
    assert rows(random_walk_returns(g, 3), "p1", "p2", "p3") == [[0, 0.5, 0.25]] * 3 + [[0, 0, 0]]


def test_folds_are_even_and_repeatable(spark):
    frame = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, label int")
    folds = stratified_folds(frame, "id", "label", 5, 1)
    sizes = [r["count"] for r in folds.groupBy("label", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and folds.count() == 50
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, stratified_folds(frame.repartition(7), "id", "label", 5, 1).collect()))


def test_running_sum(spark):
    out = running_sum(spark.range(100).selectExpr("id", "id * 2 as v").repartition(5), ["id"], "v", "s", 4)
    assert all(r.s == r.id * (r.id + 1) for r in out.collect())
